"""Aggregates that are published, partly replaced and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.plans.base import query
from playtide.plans.charts import CHART_SQL, frames
from playtide.sources.publish import publish, replace_parts, shared_dir


@query("published_weekly_tracks", CHART_SQL + " select year, week, track_id, sum(plays)::bigint as play_count, sum(ms)::bigint as total_ms from (select *, (week + 3) // 364 as year from cp) group by all")
def published_weekly_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full rebuild from rows without the last year, then replacement of the affected years only."""
    cp = frames(spark, sf_dir)["cp"].withColumn("year", F.call_function("div", F.col("week") + 3, F.lit(364)).cast("long"))
    total = lambda df: df.groupBy("year", "week", "track_id").agg(F.sum("plays").alias("play_count"), F.sum("ms").alias("total_ms"))
    path = f"{shared_dir(spark)}/published/{uuid.uuid4().hex}"
    last = cp.agg(F.max("year")).first()[0] or 0
    publish(total(cp.where(F.col("year") < last)), path, "year")
    replace_parts(total(cp.where(F.col("year") >= last - 1)), path, "year")
    return spark.read.schema("week long, track_id long, play_count long, total_ms long, year long").parquet(path)
