"""Shared helpers: scratch tables, bounded broadcasts, scalable ranks, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side with at most so many rows may be broadcast; above it Spark shuffles.
BROADCAST_ROWS = 50_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, or a folder of our own where none is set and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="playtide-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of the reading stage only.
    """
    path = f"{scratch_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows prove small, else ``df``.

    ``df`` must be cheap to count, such as a materialised table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_fold(doc_id: str | Column) -> Column:
    """The remainder by 5 of the crc32 of the id as text; 0 is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def ranked(df: DataFrame, group: list[str], order: list[str], salt: Column, name: str) -> DataFrame:
    """Add ``name``, the rank from 0 of each row within ``group``, without one task per group.

    A group is split by ``salt`` (a bounded integer column); rows are ranked within
    (group, salt) and shifted by the counts of the lower salts.  The order within a
    group is therefore (salt, order).  ``df`` is read twice and must be materialised.
    """
    keyed = df.withColumn("_salt", salt)
    sizes = keyed.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    numbered = keyed.withColumn("_rn", F.row_number().over(within) - 1)
    same = [numbered[c].eqNullSafe(offsets[c]) for c in [*group, "_salt"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return numbered.join(bounded(offsets), cond, "left").select(
        *[numbered[c] for c in df.columns], (F.col("_before") + F.col("_rn")).cast("long").alias(name)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst long): node, component (its smallest node).

    Alternates the large-star and small-star steps, each a pre-aggregated minimum
    and one join back; every round is written to the shared folder.  Empty edges
    give an empty table.
    """
    cur = materialize(edges.where("src <> dst").select("src", "dst").distinct())
    last = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = materialize(both.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("dst > src").join(low, F.col("src") == F.col("u")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = materialize(large.where("src <> dst").distinct())
        # small star: every edge points down already
        low = materialize(large.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")))
        small = large.join(low, F.col("src") == F.col("u"))
        nxt = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        cur = materialize(nxt.where("src <> dst").distinct())
        sign = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(sign) == last:
            break
        last = tuple(sign)
    else:
        raise RuntimeError("components did not settle")
    star = cur.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return star.union(star.select("component", "component").distinct()).toDF("node", "component")
