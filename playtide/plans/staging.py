"""Three imports of exports made of the plays: all but the last day, all but the first, and the last again under another name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.plans.base import query
from playtide.plans.changes import _SNAPSHOTS, snapshots
from playtide.sources.plays import RAW_PLAYS_SQL
from playtide.sources.publish import shared_dir
from playtide.sources.staging import import_batch

_FIELDS = ["user_id", "end_us", "ms", "track_id", "platform"]
_COLUMNS = ", ".join(_FIELDS)
_FILE = "coalesce(user_id, -1) // 50"


@query("import_staged", f"""with {RAW_PLAYS_SQL},
{_SNAPSHOTS},
a as (select distinct {_COLUMNS} from old_rows), b as (select distinct {_COLUMNS} from new_rows),
fa as (select count(distinct {_FILE}) as n, count(*) as rows from old_rows), fb as (select count(distinct {_FILE}) as n, count(*) as rows from new_rows)
select 1 as step, n as files, 0 as known_files, rows as records, (select count(*) from a) as added from fa
union all select 2, n, 0, rows, (select count(*) from (from b except from a)) from fb union all select 3, n, n, rows, 0 from fb""")
def import_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each import: the second adds what the first lacks, the third nothing."""
    old, new = snapshots(spark, sf_dir)
    root = f"{shared_dir(spark)}/imports/{uuid.uuid4().hex}"
    out = []
    for step, (rows, name) in enumerate(((old, "old"), (new, "new"), (new, "again")), 1):
        part = F.floor(F.coalesce("user_id", F.lit(-1)) / 50).cast("string")
        done = import_batch(spark, root, "plays", rows.select(F.concat(F.lit(f"{name}-"), part).alias("file"), *_FIELDS))
        out.append((step, done.files, done.known_files, done.records, done.added))
    return spark.createDataFrame(out, "step int, files long, known_files long, records long, added long")


@query("import_staged_records", f"""with {RAW_PLAYS_SQL} select distinct {_COLUMNS} from raw_plays""")
def import_staged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after both imports, each once."""
    root = f"{shared_dir(spark)}/imports/{uuid.uuid4().hex}"
    for name, rows in zip(("old", "new"), snapshots(spark, sf_dir), strict=True):
        done = import_batch(spark, root, "plays", rows.select(F.lit(name).alias("file"), *_FIELDS))
    return done.generation.read(spark, "plays").select(*_FIELDS)
