"""A year against the year before over the days that both cover.

Every export covers an interval of days of a listener.  Their union is cut at calendar years;
the parts of the year before are moved a year on and intersected with the year's own.  Plays
are compared inside these common intervals only, so that a missing month is not a quiet one.

29 February is compared with 28 February; moved intervals keep the days whose counterpart
they cover.  A year with fewer than ``MIN_DAYS`` common days is not comparable.  Intervals
without bounds or with the last day first count as none; days are numbers from 1970-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_DAYS = 90


def _date(day: Column) -> Column:
    return F.date_from_unix_date(day.cast("int"))


def _day(date: Column) -> Column:
    return F.unix_date(date).cast("long")


def moved(day: Column, months: int) -> Column:
    """The same day so many months away, the last one of a shorter month."""
    return _day(F.add_months(_date(day), months))


def covered(exports: DataFrame, who: str) -> DataFrame:
    """``who``, first_day, last_day: the union of intervals; touching ones are one."""
    sound = exports.where((F.col("first_day") <= F.col("last_day")) & F.col(who).isNotNull()).select(who, "first_day", "last_day").distinct()
    order = Window.partitionBy(who).orderBy("first_day", "last_day")
    reach = F.max("last_day").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("first_day") > reach + 1)).cast("long")
    named = sound.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(who, "_island").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).drop("_island")


def by_year(intervals: DataFrame) -> DataFrame:
    """Intervals cut at calendar years, with ``year``."""
    year = lambda c: F.year(_date(F.col(c)))
    cut = intervals.withColumn("year", F.explode(F.sequence(year("first_day"), year("last_day"))))
    start, end = _day(F.make_date("year", F.lit(1), F.lit(1))), _day(F.make_date("year", F.lit(12), F.lit(31)))
    return cut.withColumns({"first_day": F.greatest("first_day", start), "last_day": F.least("last_day", end), "year": F.col("year").cast("long")})


def common_intervals(exports: DataFrame, who: str) -> DataFrame:
    """``who``, year, first_day, last_day, base_first, base_last: days of the year and of the year before that are both covered."""
    own = by_year(covered(exports, who))
    first, last = F.col("first_day"), F.col("last_day")
    before = own.select(
        who, (F.col("year") + 1).alias("year"), F.greatest(moved(first, 12), moved(first - 1, 12) + 1).alias("_first"), F.greatest(moved(last, 12), moved(last + 1, 12) - 1).alias("_last")
    ).where("_first <= _last")  # 29 February alone has no day a year on
    both = own.join(before, [who, "year"]).where((first <= F.col("_last")) & (F.col("_first") <= last))
    shared = both.select(who, "year", F.greatest(first, "_first").alias("first_day"), F.least(last, "_last").alias("last_day"))
    return shared.withColumns({"base_first": moved(F.col("first_day"), -12), "base_last": moved(F.col("last_day"), -12)})


def year_comparison(plays: DataFrame, exports: DataFrame, who: str, min_days: int = MIN_DAYS) -> DataFrame:
    """``who``, year, intervals, days, current, baseline, comparable of each year with common days; ``plays`` has ``who`` and day."""
    common = common_intervals(exports, who)
    daily = plays.groupBy(who, "day").agg(F.count(F.lit(1)).alias("n"))  # a listener has as many rows as days
    sides = [
        daily.join(common, who).where(F.col("day").between(F.col(a), F.col(b))).groupBy(who, "year").agg(F.sum("n").alias(name))
        for a, b, name in (("first_day", "last_day", "current"), ("base_first", "base_last", "baseline"))
    ]
    years = common.groupBy(who, "year").agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("last_day") - F.col("first_day") + 1).alias("days"))
    out = years.join(sides[0], [who, "year"], "left").join(sides[1], [who, "year"], "left").na.fill(0, ["current", "baseline"])
    return out.withColumn("comparable", F.col("days") >= min_days)
