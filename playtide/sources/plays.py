"""The supplied tables as plays.

``events`` are raw stop events (each user a listener); order lines are chart plays
over several years.  The mapping uses exact expressions only, so that SQL repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.functions.timefns import micros
from playtide.sources.publish import side


def raw_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """play_id, user_id, end_us (stop time), ms, track_id, album_id, artist_id, platform, duration_ms."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    track = F.pmod(k, F.lit(10))
    return ev.select(
        F.col("event_id").alias("play_id"), "user_id", micros(F.col("ts")).alias("end_us"), F.floor(F.col("value") * 1000).cast("long").alias("ms"),
        track.alias("track_id"), F.pmod(track, F.lit(5)).alias("album_id"), F.pmod(track, F.lit(3)).alias("artist_id"),
        F.col("event_type").alias("platform"), (20000 + 10000 * F.pmod(track, F.lit(5))).alias("duration_ms"),
    )


def chart_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """end_us, track_id (part), album_id (brand), artist_id (supplier), plays, ms: one row per order line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    joined = li.join(side(orders), li.l_orderkey == orders.o_orderkey).join(side(part), li.l_partkey == part.p_partkey)
    return joined.select(
        micros(F.col("o_orderdate")).alias("end_us"), F.col("l_partkey").alias("track_id"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("album_id"),
        F.col("l_suppkey").alias("artist_id"), F.lit(1).cast("long").alias("plays"), (F.col("l_quantity") * 1000).cast("long").alias("ms"),
    )


RAW_PLAYS_SQL = """raw_plays as (
  select event_id as play_id, user_id, epoch_us(ts) as end_us, cast(floor(value * 1000) as bigint) as ms, k % 10 as track_id, (k % 10) % 5 as album_id,
         (k % 10) % 3 as artist_id, event_type as platform, 20000 + 10000 * ((k % 10) % 5) as duration_ms
  from (select *, cast(json_extract(props, '$.k') as bigint) as k from events))"""

CHART_PLAYS_SQL = """chart_plays as (
  select epoch_us(o_orderdate) as end_us, l_partkey as track_id, cast(regexp_extract(p_brand, '(\\d+)$', 1) as bigint) as album_id, l_suppkey as artist_id,
         1 as plays, cast(l_quantity * 1000 as bigint) as ms
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
