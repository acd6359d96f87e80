"""Weekly charts: rankings, running metrics, power scores, summaries, streaks and yearly charts.

A weekly frame has entity, week (day number on which it starts), rank, plays and ms.
Rankings partition by week, everything that follows an entity through time by entity,
so each window holds one week's or one entity's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.config import ChartConfig
from playtide.functions.timefns import week_no
from playtide.operators.ranking import numbered

#: Weeks that start at most so many days apart are adjacent.
ADJACENT_DAYS = 8


def weekly_totals(plays: DataFrame, entity: str, cfg: ChartConfig) -> DataFrame:
    """entity, week, plays, ms of every entity that was played in the week."""
    week = week_no(F.col("end_us"), cfg.week_start_dow, cfg.week_start_hour)
    return plays.groupBy(F.col(entity).alias("entity"), week.alias("week")).agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms")).where("plays > 0")


def weekly_rankings(totals: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` of each week by plays, then time, then id."""
    w = Window.partitionBy("week").orderBy(F.desc("plays"), F.desc("ms"), F.asc("entity"))
    return totals.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_n)


def running_metrics(weekly: DataFrame) -> DataFrame:
    """Add running_peak, running_wks and running_peak_wks (weeks spent at the running peak so far)."""
    w = Window.partitionBy("entity").orderBy("week")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    peaked = weekly.withColumns({"running_peak": F.min("rank").over(so_far), "running_wks": F.row_number().over(w).cast("long")})
    at_peak = Window.partitionBy("entity", "running_peak").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return peaked.withColumn("running_peak_wks", F.sum((F.col("rank") == F.col("running_peak")).cast("long")).over(at_peak))


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def scored_rows(weekly: DataFrame, *by: str) -> DataFrame:
    """Add weekly, the week's score of each row; the medians are taken over ``by`` (all rows without)."""
    weeks = weekly.groupBy(*by, "week").agg(F.sum("plays").alias("week_total"), F.median("plays").alias("week_median"), F.max(F.when(F.col("rank") == 2, F.col("plays"))).alias("second"))
    # one row a week: the median over weeks needs no partition of all rows
    base = weeks.groupBy(*by).agg(F.median("week_total").alias("baseline"))
    weeks = weeks.join(base, list(by)) if by else weeks.crossJoin(F.broadcast(base))
    rows = weekly.join(weeks, [*by, "week"])
    place = F.greatest(F.lit(1.0), F.rint(200 * F.pow(F.lit(0.87), F.col("rank") - 1)))
    competition = _clip(F.sqrt(F.col("week_total") / F.col("baseline")), 0.7, 1.5)
    first = F.when(F.col("second").isNull(), 2.0).otherwise(1 + _clip(0.5 * F.log2(F.col("plays") / F.col("second")), 0.0, 1.0))
    other = 1 + _clip(0.4 * F.log2(F.col("plays") / F.col("week_median")), 0.0, 0.8)
    return rows.withColumn("score", place * competition * F.when(F.col("rank") == 1, first).otherwise(other))


def power_scores(weekly: DataFrame, kind: str, *by: str) -> DataFrame:
    """entity, power, raw (rounded to 4 places), peak, weeks, weeks_at_peak, no1_weeks, power_rank."""
    s = scored_rows(weekly, *by)
    own = Window.partitionBy(*by, "entity")
    s = s.withColumn("peak", F.min("rank").over(own))
    agg = s.groupBy(*by, "entity").agg(
        F.sum("score").alias("raw"), F.count_distinct("week").alias("weeks"), F.min("rank").alias("peak"), F.sum((F.col("rank") == F.col("peak")).cast("long")).alias("weeks_at_peak"),
        F.sum((F.col("rank") == 1).cast("long")).alias("no1_weeks"), F.min_by("rank", "week").alias("first_rank"),
    )
    bonus = F.when(F.col("peak") == 1, 200).when(F.col("peak") == 2, 100).when(F.col("peak") == 3, 50).otherwise(0)
    extra = F.when(F.col("first_rank") == 1, 50).otherwise(0) if kind == "track" else 40 * F.col("no1_weeks")
    power = F.rint(F.round(F.col("raw") + 45 * F.sqrt("weeks") + bonus + extra, 6)).cast("long")
    order = F.desc("power"), F.asc("entity")
    out = agg.withColumn("power", power).withColumn("raw", F.round("raw", 4)).drop("first_rank")
    if not by:
        return numbered(out, "power_rank", *order)
    return out.withColumn("power_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def summary(weekly: DataFrame) -> DataFrame:
    """Per entity: peak, weeks, weeks_at_peak, no1_weeks, first/last week, first_peak_week, chart_plays, debut_no1."""
    w = weekly.withColumn("peak", F.min("rank").over(Window.partitionBy("entity")))
    at = F.col("rank") == F.col("peak")
    out = w.groupBy("entity").agg(
        F.min("rank").alias("peak"), F.count_distinct("week").alias("weeks"), F.sum(at.cast("long")).alias("weeks_at_peak"), F.sum((F.col("rank") == 1).cast("long")).alias("no1_weeks"),
        F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.min(F.when(at, F.col("week"))).alias("first_peak_week"), F.sum("plays").alias("chart_plays"),
    )
    return out.withColumn("debut_no1", (F.col("peak") == 1) & (F.col("first_week") == F.col("first_peak_week")))


def change_column(weekly: DataFrame) -> DataFrame:
    """Add change: NEW, RE after a gap, else the step from the previous week's rank."""
    w = Window.partitionBy("entity").orderBy("week")
    step = F.lag("rank").over(w) - F.col("rank")
    gap = F.col("week") - F.lag("week").over(w)
    move = F.when(step > 0, F.concat(F.lit("up "), step.cast("string"))).when(step < 0, F.concat(F.lit("down "), (-step).cast("string"))).otherwise("same")
    return weekly.withColumn("change", F.when(gap.isNull(), "NEW").when(gap > ADJACENT_DAYS, "RE").otherwise(move))


def streaks(weekly: DataFrame, *same: str) -> DataFrame:
    """entity, length, start_week, end_week of the longest run of adjacent weeks (and equal ``same``); the earliest wins."""
    w = Window.partitionBy("entity").orderBy("week")
    fresh = F.coalesce(F.col("week") - F.lag("week").over(w) > ADJACENT_DAYS, F.lit(True))
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    island = weekly.withColumn("island", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = [F.first(c).alias(c) for c in same]
    found = island.groupBy("entity", "island").agg(F.count(F.lit(1)).alias("length"), F.min("week").alias("start_week"), F.max("week").alias("end_week"), *keep)
    best = Window.partitionBy("entity").orderBy(F.desc("length"), F.asc("start_week"))
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "island")


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows with their place; the sort keeps only ``n`` rows of each partition."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def replaced_leaders(weekly: DataFrame, people: DataFrame) -> DataFrame:
    """week, prev_entity, entity, shared_artists: a number one that follows another of the same artists.

    ``people`` holds distinct (entity, artist_id).  The window holds one row a week; weeks without a
    number one end the succession, ties cannot occur within a ranking.
    """
    order = Window.orderBy("week")
    first = weekly.where("rank = 1").select("week", "entity", F.lag("entity").over(order).alias("prev_entity"), (F.col("week") - F.lag("week").over(order)).alias("gap"))
    moved = first.where((F.col("gap") <= ADJACENT_DAYS) & (F.col("entity") != F.col("prev_entity"))).drop("gap")
    before = people.select(F.col("entity").alias("prev_entity"), "artist_id")
    return moved.join(people, "entity").join(before, ["prev_entity", "artist_id"]).groupBy("week", "prev_entity", "entity").agg(F.count(F.lit(1)).alias("shared_artists"))


def best_of_decade(scores: DataFrame, decades: DataFrame, n: int = 5) -> DataFrame:
    """decade, entity, power, weeks, peak, place: the ``n`` best of each decade; ``decades`` has entity and decade, others are left out."""
    best = Window.partitionBy("decade").orderBy(F.desc("power"), F.desc("weeks"), "peak", "entity")
    placed = scores.join(decades.where("decade is not null"), "entity").withColumn("place", F.row_number().over(best).cast("long"))
    return placed.where(F.col("place") <= n).select("decade", "entity", "power", "weeks", "peak", "place")
