"""Places of all entities in one order: DataFrames whose order is dealt by ranges, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.operators.charts import top_rows
from playtide.operators.ranking import numbered
from playtide.plans import archive
from playtide.plans.base import query
from playtide.plans.stats import PREFIX
from playtide.plans.timeline import events, hours

RECENT_DAYS = 28
MILESTONES = (1, 10, 50, 100, 500, 1000)
TOP = 5


def played(e: DataFrame, k: str) -> DataFrame:
    return e.groupBy(k).agg(F.count(F.lit(1)).alias("plays"), F.min("counted_us").alias("first_us"), F.max("counted_us").alias("last_us"), F.count_distinct("track_id").alias("tracks"))


def listened(s: DataFrame, k: str) -> DataFrame:
    return s.groupBy(k).agg(F.sum("ms").cast("long").alias("total_ms"))


def chart_rows(spark: SparkSession, sf_dir: str, k: str) -> DataFrame:
    """Entities that were played and listened to, with their share of all plays of such entities."""
    rows = played(events(spark, sf_dir), k).join(listened(hours(spark, sf_dir), k), k)
    placed = numbered(rows, "place", F.desc("plays"), F.desc("total_ms"), F.asc(k))
    total = F.broadcast(placed.agg(F.sum("plays").alias("all_plays")))  # one row
    return placed.crossJoin(total).withColumn("share", F.round(F.lit(100.0) * F.col("plays") / F.col("all_plays"), 2)).drop("all_plays")


def entity_ranks(spark: SparkSession, sf_dir: str, k: str) -> DataFrame:
    """Places by plays of all time and of the last ``RECENT_DAYS`` days."""
    days = events(spark, sf_dir).groupBy(k, "day").agg(F.count(F.lit(1)).alias("n"))
    last = F.broadcast(days.agg(F.max("day").alias("last_day")))  # one row
    recent = F.when(F.col("day") > F.col("last_day") - RECENT_DAYS, F.col("n")).otherwise(0)
    rows = days.crossJoin(last).groupBy(k).agg(F.sum("n").alias("plays"), F.sum(recent).alias("recent"))
    return numbered(numbered(rows, "rank_lifetime", F.desc("plays"), F.asc(k)), "rank_recent", F.desc("recent"), F.asc(k))


def rank_map(spark: SparkSession, sf_dir: str, k: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(k).agg(F.count(F.lit(1)).alias("plays")).join(listened(hours(spark, sf_dir), k), k)
    return numbered(numbered(rows, "by_plays", F.desc("plays"), F.asc(k)), "by_time", F.desc("total_ms"), F.asc(k))


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an artist's tracks are among the ``TOP`` of all; only these few are placed."""
    tracks = events(spark, sf_dir).groupBy("artist_id", "track_id").agg(F.count(F.lit(1)).alias("plays"))
    best = tracks.orderBy(F.desc("plays"), "artist_id", "track_id").limit(TOP).groupBy("artist_id").agg(F.count(F.lit(1)).alias("inside"))
    return tracks.groupBy("artist_id").agg(F.count(F.lit(1)).alias("tracks")).join(best, "artist_id", "left").select("artist_id", F.coalesce("inside", F.lit(0)).cast("long").alias("inside"), "tracks")


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that reach a milestone; the sort keeps no more rows than the largest one."""
    saved = archive.frames(spark, sf_dir)["sav"]
    placed = top_rows(saved, max(MILESTONES), F.asc("saved"), F.asc("who"))
    return placed.where(F.col("place").isin(*MILESTONES)).select(F.col("place").alias("milestone"), "who", "saved")


for _e in ("track", "album", "artist"):
    _k = f"{_e}_id"
    _both = f"(select {_k}, count(*) as plays, min(counted_us) as first_us, max(counted_us) as last_us, count(distinct track_id) as tracks from e group by {_k}) a join (select {_k}, sum(ms)::bigint as total_ms from s group by {_k}) b using ({_k})"
    query(f"chart_rows_{_e}", f"{PREFIX} select {_k}, plays, total_ms, first_us, last_us, tracks, round(100e0 * plays / sum(plays) over (), 2) as share, row_number() over (order by plays desc, total_ms desc, {_k}) as place from {_both}")(
        lambda s, d, k=_k: chart_rows(s, d, k)
    )
    query(f"entity_ranks_{_e}", f"""{PREFIX} select {_k}, plays, recent, row_number() over (order by plays desc, {_k}) as rank_lifetime, row_number() over (order by recent desc, {_k}) as rank_recent
from (select {_k}, count(*) as plays, count(*) filter (where day > (select max(day) from e) - {RECENT_DAYS}) as recent from e group by {_k})""")(lambda s, d, k=_k: entity_ranks(s, d, k))  # fmt: skip
    query(f"entity_rank_map_{_e}", f"{PREFIX} select {_k}, plays, total_ms, row_number() over (order by plays desc, {_k}) as by_plays, row_number() over (order by total_ms desc, {_k}) as by_time from {_both}")(
        lambda s, d, k=_k: rank_map(s, d, k)
    )
query("entity_top_share", PREFIX + f""" select artist_id, count(*) filter (where place <= {TOP}) as inside, count(*) as tracks
from (select artist_id, track_id, row_number() over (order by count(*) desc, artist_id, track_id) as place from e group by artist_id, track_id) group by artist_id""")(top_share)  # fmt: skip
query("journey_milestones", f"{archive.PREFIX} select n as milestone, who, saved from (select who, saved, row_number() over (order by saved, who) as n from sav) where n in {MILESTONES}")(milestones)
