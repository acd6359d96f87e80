"""Incremental execution: a ledger of weeks, a search index and merged runs that follow a new export.

The old export of order lines ends before the last chart week, the new one holds all.  The old
export of documents lacks the last source and calls the first language's source otherwise; the new
one has dropped the first source.  The exports of plays are those of ``plans.changes``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import US_PER_MS, ChartConfig, PlayFilters
from playtide.functions.timefns import week_no
from playtide.operators import charts as C
from playtide.operators import ledger as L
from playtide.operators import maintenance, merge_chain
from playtide.operators.search import search
from playtide.plans import searching
from playtide.plans.base import query
from playtide.plans.changes import _SNAPSHOTS, snapshots
from playtide.plans.charts import CHART_SQL, KINDS, SIZE
from playtide.sources.plays import RAW_PLAYS_SQL, chart_plays
from playtide.sources.publish import scratch, shared_dir


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/generations/{uuid.uuid4().hex}"


def ledger_chart(kind: str):  # noqa: ANN201
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The weekly chart, read from a ledger that was published for the old export and followed the new one."""
        cfg, root = ChartConfig(), _root(spark)
        new = scratch(chart_plays(spark, sf_dir))
        week = week_no(F.col("end_us"), cfg.week_start_dow, cfg.week_start_hour)
        last = new.agg(F.max(week)).first()[0]
        old = new.where(week < F.lit(last))
        L.refresh(spark, root, old, cfg)
        L.refresh(spark, root, new, cfg, L.changed_weeks(old, new, cfg))
        return C.weekly_rankings(L.weekly(spark, root, new, kind, cfg), SIZE[kind]).select("entity", "week", "plays", "ms", "rank")

    return run


for _k in KINDS:
    query(f"ledger_chart_{_k}", CHART_SQL + f" select entity, week, plays, ms, rank from w_{_k}")(ledger_chart(_k))

_FIRST_SOURCE = "(select min(coalesce(source, '')) from documents)"


@query("search_index_delta", searching.pages_sql(f"coalesce(source, '') <> {_FIRST_SOURCE}"))
def search_index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages from an index of the old export that took in the differences to the new one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ends = F.broadcast(docs.agg(F.min(F.coalesce("source", F.lit(""))).alias("first"), F.max(F.coalesce("source", F.lit(""))).alias("last"), F.min("lang").alias("lang_1")))
    placed = docs.crossJoin(ends).withColumn("of", F.coalesce("source", F.lit("")))
    other = F.coalesce(F.col("lang") == F.col("lang_1"), F.lit(False))
    old = placed.where(F.col("of") != F.col("last")).withColumn("source", F.when(other, F.lit("elsewhere")).otherwise(F.col("source")))
    kept = placed.where(F.col("of") != F.col("first"))
    now = maintenance.publish_index(spark, _root(spark), searching.entities(old), "old export")
    changed = kept.where((F.col("of") == F.col("last")) | other)
    deleted = placed.where(F.col("of") == F.col("first")).select(F.col("doc_id").alias("entity"))
    now = maintenance.apply_delta(spark, now, searching.entities(changed), deleted, "new export")
    return search(maintenance.read_index(spark, now), scratch(searching.asked(docs)))


_CFG = PlayFilters()


@query("change_merge_chain", f"""with {RAW_PLAYS_SQL},
{_SNAPSHOTS},
p as (select play_id, user_id, end_us as us, end_us - greatest(coalesce(ms, 0), 0) * {US_PER_MS} as b, track_id from new_rows where end_us is not null),
l as (select *, lag(us) over w as pat, lag(track_id) over w as pt, row_number() over w = 1 as head from p window w as (partition by user_id order by us, play_id)),
f as (select *, head or track_id is distinct from pt or b - pat > {_CFG.max_gap_minutes * 60_000_000} or b - pat < -{_CFG.overlap_tolerance_us} as fresh from l),
s as (select *, sum(fresh::int) over (partition by user_id order by us, play_id) as run from f)
select play_id, user_id, first_value(us) over w as start_us, first_value(play_id) over w as start_id from s window w as (partition by user_id, run order by us, play_id)""")
def change_merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the new export, from those of the old one; only the runs that the difference touches are merged again."""
    old, new = (df.where("end_us is not null") for df in snapshots(spark, sf_dir))
    known = scratch(merge_chain.run_names(old, _CFG))
    return merge_chain.recalculated_runs(known, old, new, _CFG).select("play_id", "user_id", "start_us", "start_id")
