"""Streaming queries drained to a table, so that SQL can check them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.plans.base import query
from playtide.sources.publish import shared_dir
from playtide.streaming import plays as P

#: All files in one trigger: the watermark then drops no row, whatever order the files are in.
ALL_FILES = 2**31 - 1


def drained(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All rows of the stream over the events table, read once in one available-now run.

    The path is a pattern, so that a single file and a folder of files both stream.  Every
    batch is written as Parquet in the shared folder, with the checkpoint, and the table
    is read from there; no row passes through the driver.
    """
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = build(P.event_stream(spark, f"{sf_dir}/[e]vents.parquet", ALL_FILES))
    batches: set[int] = set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batches.add(number)

    running = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    if not batches:
        return spark.createDataFrame([], rows.schema)
    # in complete mode the last batch holds the whole table
    wanted = [max(batches)] if mode == "complete" else sorted(batches)
    return spark.read.schema(rows.schema).parquet(*(f"{folder}/rows/{n}" for n in wanted))


@query("stream_deduplicated", "select event_id, user_id, event_type from events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir, P.deduplicated, "append").select("event_id", "user_id", "event_type")


@query("stream_open_windows", "select epoch_us(date_trunc('day', ts)) as start_us, event_type, count(*) as n from events group by all")
def stream_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir, P.open_windows, "complete").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_sessions", """
with f as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 5 minutes then 0 else 1 end as fresh, event_id from events),
b as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from f)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from b group by user_id, burst""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir, P.sessions, "complete").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_type_runs", """
with f as (select user_id, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as fresh from events)
select user_id, sum(fresh)::bigint as runs from f group by user_id""")
def stream_type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(spark, sf_dir, P.type_runs, "update").groupBy("user_id").agg(F.max("runs").alias("runs"))
