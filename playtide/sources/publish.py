"""Scratch tables and published aggregates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most so many rows may be broadcast.
SIDE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="playtide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (narrow and cheap to count) as a side of a join: broadcast if its counted rows are few, else it is shuffled.

    Left alone, the optimizer takes the size of a compressed file for that of the rows in memory.
    """
    rows = SIDE_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def publish(df: DataFrame, path: str, by: str) -> None:
    """A full rebuild: the table at ``path``, one folder for each value of ``by``, large ones by several tasks."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Replace the values of ``by`` that ``df`` holds; other folders stay as they are."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
