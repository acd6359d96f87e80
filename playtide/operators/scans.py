"""Values carried along an order of all rows, by ranges of the order and summaries between them.

A window over one key holds all its rows in one task; here a key may have any number of
rows.  Rows are dealt by ranges of the order and written; each range computes its own part,
one summary row a range is carried on in one small window, and both are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.sources.publish import scratch


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    return scratch(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _carry(held: DataFrame, last: Column, where: Column | bool, by: str, order: list[Column]) -> DataFrame:
    """(_range, _carried): the last row (by, value) with ``where`` of the ranges before, in the order of the ranges."""
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ends = held.withColumn("_at", place).where(where).groupBy("_range").agg(F.max_by(F.struct(F.col(by).alias("by"), last.alias("value")), "_at").alias("_last"))
    ranges = held.select("_range").distinct().join(ends, "_range", "left")  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))


def carried(df: DataFrame, value: Column, name: str, by: str, *order: Column, down: bool = False) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` up to and with each row in ``order``, among the rows of ``by``.

    ``order`` tells rows apart within ``by``; give it reversed with ``down`` for the next value instead.
    """
    ordered = [F.col(by).desc_nulls_last() if down else F.col(by).asc_nulls_first(), *order]
    held = _dealt(df.withColumn("_value", value), ordered)
    known = _carry(held, F.col("_value"), F.col("_value").isNotNull(), by, ordered)
    own = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumn("_own", F.last("_value", ignorenulls=True).over(own)).join(known, "_range")
    earlier = F.when(F.col("_carried.by").eqNullSafe(F.col(by)), F.col("_carried.value"))
    return inside.withColumn(name, F.coalesce("_own", earlier)).drop("_value", "_range", "_own", "_carried")


def preceding(df: DataFrame, value: Column, name: str, by: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: ``value`` (not null) of the row before in ``order``, among the rows of ``by``; null at its first."""
    ordered = [F.col(by).asc_nulls_first(), *order]
    held = _dealt(df.withColumn("_value", value), ordered)
    known = _carry(held, F.col("_value"), F.lit(True), by, ordered)
    inside = held.withColumn("_own", F.lag("_value").over(Window.partitionBy("_range", by).orderBy(*order))).join(known, "_range")
    earlier = F.when(F.col("_carried.by").eqNullSafe(F.col(by)), F.col("_carried.value"))
    return inside.withColumn(name, F.coalesce("_own", earlier)).drop("_value", "_range", "_own", "_carried")


def running_max(df: DataFrame, value: Column, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: the greatest ``value`` of the rows before each row in ``order``, which tells all rows apart; null at first."""
    held = _dealt(df.withColumn("_value", value), list(order))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = held.groupBy("_range").agg(F.max("_value").alias("_top"))
    known = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = held.withColumn("_own", F.max("_value").over(own)).join(known, "_range")
    return inside.withColumn(name, F.greatest("_own", "_carried")).drop("_value", "_range", "_own", "_carried")
