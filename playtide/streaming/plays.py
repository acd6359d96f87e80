"""Structured Streaming forms: deduplication, open windows, sessions and play runs.

Each function takes a streaming (or static) DataFrame with event_id, ts (timestamp),
user_id and event_type and returns the transformed DataFrame; the caller attaches the
sink.  State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in ``folder``."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def open_windows(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    """Events by window and type; a window is final when the watermark passes it."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Bursts of a user: events at most ``gap`` apart."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def type_runs(events: DataFrame, late: str = LATE) -> DataFrame:
    """Running totals of a user's changes of event type, kept as state by user (custom stateful operator)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, runs = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            runs += kind != last
            last = kind
        state.update((last, runs))
        yield pd.DataFrame({"user_id": [key[0]], "runs": [runs]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, runs long", "last string, runs long", "update", GroupStateTimeout.NoTimeout)
