"""Records of single listeners and of the whole history: runs, milestones, skips, years."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.sources.publish import scratch


def no_repeat_runs(events: DataFrame, entity: str) -> DataFrame:
    """user_id, length: the longest run without a repeat; a repeat starts a new run of that entity alone.

    A listener's plays are folded in order over sorted partitions; the state is the
    current run, never the history.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, run, best = None, set(), 0
        for pdf in batches:
            done = []
            for u, x in zip(pdf["user_id"], pdf["x"], strict=True):
                if u != user:
                    done += [(user, best)] if best else []
                    user, run, best = u, set(), 0
                if x in run:
                    run = set()
                run.add(x)
                best = max(best, len(run))
            yield pd.DataFrame(done, columns=["user_id", "length"], dtype="int64")
        if best:
            yield pd.DataFrame([(user, best)], columns=["user_id", "length"], dtype="int64")

    ordered = events.select("user_id", "counted_us", "event_id", F.col(entity).alias("x")).repartition("user_id").sortWithinPartitions("user_id", "counted_us", "event_id")
    return ordered.mapInPandas(fold, "user_id long, length long")


#: Rows of a range of the order of milestones, about.
RANGE_ROWS = 1_000_000


def milestone_targets(total: int) -> list[int]:
    """The ladder of completed milestones for ``total`` plays (fixed values)."""
    full = lambda step: total // step * step
    if total < 3000:
        return list(range(500, full(500) + 1, 500))
    if total <= 10_000:
        return sorted({full(1000), *(t for t in (1000, 2000, 5000, 8000) if t <= total)})
    return [1000, 5000, 10_000, *range(20_000, full(10_000) + 1, 10_000)]


def nth_rows(frame: DataFrame, order: list[str], targets: list[int], total: int = 0) -> DataFrame:
    """The rows at the places ``targets`` (from 1) of the whole order of ``total`` rows, with ``milestone``.

    Ranges of the order of about ``RANGE_ROWS`` rows are sorted once and counted; the targets then name
    a range and a place in it, so a task's rows do not grow with the table.
    """
    n = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)
    placed = frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())  # range, place from 0
    parts = scratch(placed.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most n rows
    before = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    hits = F.filter(F.lit(targets) if targets else F.array().cast("array<int>"), lambda t: (t > F.col("_before")) & (t <= F.col("_before") + F.col("_n")))
    wanted = before.select("_part", "_before", F.explode(hits).alias("milestone")).select("_part", (F.col("milestone") - F.col("_before") - 1).alias("_row"), "milestone")
    return parts.join(F.broadcast(wanted), ["_part", "_row"]).drop("_part", "_row")


def playback_milestones(events: DataFrame, order: list[str]) -> DataFrame:
    total = events.count()
    return nth_rows(events, order, milestone_targets(total), total)


def share_of(events: DataFrame, by: str, flag: str, at_least: int, *then: Column, limit: int = 50) -> DataFrame:
    """``by``, plays, flagged, pct of the groups with ``at_least`` plays, the highest shares first."""
    g = events.groupBy(by).agg(F.count(F.lit(1)).alias("plays"), F.sum(F.col(flag).cast("long")).alias("flagged")).where(F.col("plays") >= at_least)
    rate = F.col("flagged") / F.col("plays")
    return g.withColumn("pct", F.round(100 * rate, 1)).orderBy(rate.desc(), *then).limit(limit)


def comeback(events: DataFrame, entity: str, gap: int = 7) -> DataFrame:
    """The longest silence of each entity of ``gap`` days or more, the earliest of equals: gap, back_day."""
    w = Window.partitionBy(entity).orderBy("day")
    gaps = events.select(entity, "day").distinct().withColumn("gap", F.col("day") - F.lag("day").over(w)).where(F.col("gap") >= gap)
    best = gaps.groupBy(entity).agg(F.max(F.struct("gap", (-F.col("day")).alias("d"))).alias("m"))
    return best.select(entity, "m.gap", (-F.col("m.d")).alias("back_day"))


def fastest_milestones(events: DataFrame, entity: str, order: list[str], targets: tuple[int, ...] = (50, 100, 250)) -> DataFrame:
    """entity, target, days from its first to its ``target``-th play."""
    w = Window.partitionBy(entity).orderBy(*order)
    at = events.select(entity, "day", F.row_number().over(w).alias("n"), F.first("day").over(w).alias("first_day")).where(F.col("n").isin(*targets))
    return at.select(entity, F.col("n").cast("long").alias("target"), (F.col("day") - F.col("first_day")).alias("days"))


def rediscovery(events: DataFrame, entity: str, plays: int = 10, idle: int = 90, limit: int = 20) -> DataFrame:
    """Entities of at least ``plays`` plays that have rested for more than ``idle`` days."""
    last = events.agg(F.max("day").alias("_today"))
    g = events.groupBy(entity).agg(F.count(F.lit(1)).alias("plays"), F.max("day").alias("last_day")).join(F.broadcast(last), F.col("last_day") < F.col("_today") - idle).drop("_today")
    return g.where(F.col("plays") >= plays).orderBy(F.desc("plays"), F.asc("last_day"), F.asc(entity)).limit(limit)


def new_year(events: DataFrame, at_least: int = 3) -> DataFrame:
    """season (the new year), plays, top_track, top_artist of the nights from 20:00 on 31 December to 04:59 on 1 January."""
    date = F.date_from_unix_date(F.col("day").cast("int"))
    eve = (F.month(date) == 12) & (F.dayofmonth(date) == 31) & (F.col("hour") >= 20)
    morning = (F.month(date) == 1) & (F.dayofmonth(date) == 1) & (F.col("hour") <= 4)
    night = events.where(eve | morning).withColumn("season", (F.year(date) + eve.cast("int")).cast("long"))

    def top(entity: str, name: str) -> DataFrame:
        n = night.groupBy("season", entity).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("season").agg(F.max(F.struct("n", (-F.col(entity)).alias("i"))).alias("m")).select("season", (-F.col("m.i")).alias(name))

    total = night.groupBy("season").agg(F.count(F.lit(1)).alias("plays")).where(F.col("plays") >= at_least)
    return total.join(top("track_id", "top_track"), "season").join(top("artist_id", "top_artist"), "season")


def listening_age(events: DataFrame, releases: DataFrame, by: list[str], top: int = 50) -> DataFrame:
    """``by``, year, avg_release_year and age from the ``top`` tracks of each group and year (those with a known release year)."""
    g = events.groupBy(*by, "year", "track_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "year").orderBy(F.desc("n"), F.asc("track_id"))
    known = g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).join(releases, "track_id").where("release_year is not null")
    mean = F.bround(F.avg("release_year"), 0).cast("long")
    return known.groupBy(*by, "year").agg(mean.alias("avg_release_year")).withColumn("age", F.greatest(F.col("year") - F.col("avg_release_year"), F.lit(0)))


def trend_chaser(events: DataFrame, releases: DataFrame, by: list[str]) -> DataFrame:
    """``by``, year, score: the share of plays of tracks released that year, 50 % and more being 100."""
    j = events.join(releases, "track_id", "left")
    hit = F.sum(F.coalesce((F.col("release_year") == F.col("year")).cast("long"), F.lit(0)))
    return j.groupBy(*by, "year").agg(F.least(F.lit(100.0), F.round(200 * hit / F.count(F.lit(1)), 4)).alias("score"))


def resolve_personality(scores: DataFrame, dims: list[str], pairs: dict[tuple[str, str], str], fallback: dict[str, str], other: str) -> DataFrame:
    """``scores`` with primary (the highest of ``dims``, the first of equals) and label: of the two highest, else of the first."""
    ordered = F.sort_array(F.array(*[F.struct(F.col(d).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(dims)]), asc=False)
    one, two = F.get(ordered["d"], 0), F.get(ordered["d"], 1)
    label = F.lit(other)
    for d, v in fallback.items():
        label = F.when(one == d, v).otherwise(label)
    for (a, b), v in pairs.items():
        label = F.when((one == a) & (two == b), v).otherwise(label)
    return scores.withColumns({"primary": one, "label": label})
