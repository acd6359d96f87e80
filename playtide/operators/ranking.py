"""Places in one order of all rows, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.sources.publish import scratch


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``, the place (from 1) of each row in ``order``, which must tell all rows apart.

    Rows are dealt to tasks by ranges of the order and written once, so that a task that is
    run again keeps its range; only one row a range is summed up in one task.
    """
    part = "_range"
    held = scratch(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return held.withColumn("_own", own).join(before, part).withColumn(name, F.col("_own") + F.col("_before")).drop(part, "_own", "_before")


def ranked_by(df: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with ``name``: 1 and the rows with a greater ``value``; rows of equal value share it."""
    values = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).where(F.col(value).isNotNull())
    held = scratch(values.repartitionByRange(F.col(value).desc()).withColumn("_range", F.spark_partition_id()))
    sizes = held.groupBy("_range").agg(F.sum("_n").alias("_all"))
    before = sizes.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_before"))  # one row a range
    own = F.sum("_n").over(Window.partitionBy("_range").orderBy(F.col(value).desc())) - F.col("_n")
    places = held.withColumn("_own", own).join(before, "_range").select(value, (F.col("_before") + F.col("_own") + 1).cast("long").alias(name))
    return df.join(places, value, "left")
