"""Logical plays and listened intervals from raw stop events.

A raw row says when a play stopped and how long it lasted.  Rows of one listener are
ordered by stop time; a run continues while identity and boundary columns stay the
same, the idle gap is within the limit and an overlap within the tolerance.  A run is
then expanded into full plays of the track's duration and a remainder.  Counts belong
to the moment a play qualifies, listened time to the intervals, whatever counts.

Everything is partitioned by the listener, so no window spans all rows.  Rows without
a stop time or with null or negative length carry no time; a null duration makes each
row of the run its own play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY, US_PER_HOUR, US_PER_MS, PlayFilters
from playtide.functions.timefns import dow, local_day_no, local_hour_no


def changed(c: str, w: Window) -> Column:
    """The value differs from the previous row's; null equals null."""
    return ~F.col(c).eqNullSafe(F.lag(c).over(w))


def runs(plays: DataFrame, cfg: PlayFilters, identity: str = "track_id", boundary: tuple[str, ...] = (), listener: str = "user_id") -> DataFrame:
    """``plays`` with run_no, cum_start, cum_end (listened ms within the run), eff_start_us, eff_end_us and overlap_split."""
    order = Window.partitionBy(listener).orderBy("end_us", "play_id")
    base = plays.withColumn("ms", F.greatest(F.coalesce("ms", F.lit(0)), F.lit(0)).cast("long")).withColumn("start_us", F.col("end_us") - F.col("ms") * US_PER_MS)
    gap = F.col("start_us") - F.lag("end_us").over(order)
    fresh = F.col("end_us").isNull() | F.coalesce(gap > cfg.max_gap_minutes * 60_000_000, F.lit(False)) | F.coalesce(gap < -cfg.overlap_tolerance_us, F.lit(False))
    for c in (identity, *boundary):
        fresh = fresh | changed(c, order)
    flagged = base.withColumn("fresh", F.when(F.row_number().over(order) == 1, True).otherwise(fresh)).withColumn("split", F.coalesce(gap < -cfg.overlap_tolerance_us, F.lit(False)))
    numbered = flagged.withColumn("run_no", F.sum(F.col("fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(listener, "run_no").orderBy("end_us", "play_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = numbered.withColumn("cum_end", F.sum("ms").over(run)).withColumn("cum_start", F.col("cum_end") - F.col("ms"))
    eff = cum.withColumn("eff_start_us", F.max(F.col("start_us") - F.col("cum_start") * US_PER_MS).over(run) + F.col("cum_start") * US_PER_MS)
    return eff.withColumn("eff_end_us", F.col("eff_start_us") + F.col("ms") * US_PER_MS).withColumn("overlap_split", F.first("split").over(run)).drop("fresh", "split")


def listening_intervals(run_rows: DataFrame) -> DataFrame:
    """Every positive row's interval, fragments below any threshold included."""
    return run_rows.where("end_us is not null and ms > 0")


def threshold(duration: Column, cfg: PlayFilters) -> Column:
    """Least length that counts; a null or zero duration leaves the fixed minimum."""
    least = F.lit(max(cfg.min_ms, 0)).cast("long")
    if not cfg.dynamic_threshold:
        return least
    return F.greatest(least, F.floor(F.coalesce(duration, F.lit(0)) * cfg.ratio).cast("long"))


def logical_plays(run_rows: DataFrame, cfg: PlayFilters, listener: str = "user_id") -> DataFrame:
    """event_id, listener, anchor row's columns, ordinal, ms and counted_us of every logical play, before the effective filter."""
    run = Window.partitionBy(listener, "run_no").orderBy("end_us", "play_id")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = run_rows.withColumns({"total": F.sum("ms").over(whole), "dur": F.first("duration_ms").over(whole), "anchor": F.first("play_id").over(whole), "at": F.row_number().over(run)})
    valid = F.coalesce(F.col("dur"), F.lit(0)) > 0
    heads = rows.where((F.col("at") == 1) & valid & F.col("end_us").isNotNull() & (F.col("total") > 0))
    full, rest = F.expr("total div dur"), F.expr("total % dur")
    limit = threshold(F.col("dur"), cfg)
    planned = heads.withColumns({"full": full, "limit": limit, "n": full + ((rest > 0) & (rest >= limit)).cast("long")}).where("n > 0")
    events = planned.select(listener, "run_no", "total", "dur", "anchor", "track_id", "album_id", "artist_id", "platform", "full", "limit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal"))
    is_full = F.col("ordinal") < F.col("full")
    events = events.withColumns(
        {
            "ms": F.when(is_full, F.col("dur")).otherwise(F.col("total") - F.col("ordinal") * F.col("dur")),
            "qualify": F.when(is_full, (F.col("ordinal") + 1) * F.col("dur")).otherwise(F.col("full") * F.col("dur") + F.col("limit")),
        }
    )
    places = rows.where(valid).select(F.col(listener).alias("_l"), F.col("run_no").alias("_r"), "cum_start", "cum_end", "eff_start_us", "at")
    inside = (F.col("cum_start") < F.col("qualify")) & (F.col("qualify") <= F.col("cum_end")) | (F.col("qualify") <= 0) & (F.col("at") == 1)
    counted = events.join(places, (F.col(listener) == F.col("_l")) & (F.col("run_no") == F.col("_r")) & inside)
    keep = [listener, "anchor", "ordinal", "track_id", "album_id", "artist_id", "platform", F.col("dur").alias("duration_ms"), "ms"]
    a = counted.select(*keep, (F.col("eff_start_us") + (F.col("qualify") - F.col("cum_start")) * US_PER_MS).alias("counted_us"))
    b = rows.where(~valid & F.col("end_us").isNotNull() & (F.col("ms") > 0)).select(
        *[F.col("at") - 1 if c == "ordinal" else c for c in keep[:7]], F.lit(None).cast("long").alias("duration_ms"), "ms",
        F.least(F.col("end_us"), F.col("start_us") + max(cfg.min_ms, 0) * US_PER_MS).alias("counted_us"),
    )
    out = a.union(b.toDF(*a.columns))
    return out.withColumn("event_id", F.concat_ws(":", F.col("anchor").cast("string"), F.col("ordinal").cast("string")))


def effective(plays: DataFrame, cfg: PlayFilters) -> DataFrame:
    """Logical plays that reach their threshold; all of them without a minimum."""
    return plays if cfg.min_ms <= 0 else plays.where(F.col("ms") >= threshold(F.col("duration_ms"), cfg))


def with_calendar(df: DataFrame, us: str = "counted_us") -> DataFrame:
    """Add day, hour, dow (Monday 0), month (YYYY-MM) and year of the local time."""
    day = local_day_no(F.col(us))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return df.withColumns({"day": day, "hour": local_hour_no(F.col(us)) - day * 24, "dow": dow(day), "month": F.date_format(date, "yyyy-MM"), "year": F.year(date).cast("long")})


def slices(intervals: DataFrame, size_us: int = US_PER_HOUR, shift_us: int = LOCAL_SHIFT_US) -> DataFrame:
    """Intervals cut at local boundaries of ``size_us``: piece (its number) and ms per slice."""
    start, end = F.col("eff_start_us") + shift_us, F.col("eff_end_us") + shift_us
    first, last = F.expr(f"cast(floor((eff_start_us + {shift_us}) / {size_us}D) as bigint)"), F.expr(f"cast(floor((eff_end_us + {shift_us} - 1) / {size_us}D) as bigint)")
    cut = intervals.withColumn("piece", F.explode(F.sequence(first, last)))
    part = F.least(end, (F.col("piece") + 1) * size_us) - F.greatest(start, F.col("piece") * size_us)
    return cut.withColumn("ms", F.floor(part / US_PER_MS).cast("long"))


def hour_slices(intervals: DataFrame) -> DataFrame:
    """Slices with day, hour, dow, month, year."""
    cut = slices(intervals)
    return with_calendar(cut.withColumn("slice_us", F.col("piece") * US_PER_HOUR - LOCAL_SHIFT_US), "slice_us")


def week_slices(intervals: DataFrame, start_dow: int = 0, start_hour: int = 0) -> DataFrame:
    """Slices cut at each local day's start hour, with the week they fall in."""
    cut = slices(intervals, US_PER_DAY, LOCAL_SHIFT_US - start_hour * US_PER_HOUR)
    return cut.withColumn("week", F.col("piece") - F.pmod(F.col("piece") + (3 - start_dow), F.lit(7)))


def weighted(events: DataFrame, week_pieces: DataFrame, start_dow: int = 0, start_hour: int = 0) -> DataFrame:
    """Rows of counts (play_count 1, no time) and of time (no count), by the week each belongs to."""
    from playtide.functions.timefns import week_no

    keys = ["user_id", "track_id", "album_id", "artist_id"]
    a = events.select(*keys, week_no(F.col("counted_us"), start_dow, start_hour).alias("week"), F.lit(1).cast("long").alias("play_count"), F.lit(0).cast("long").alias("total_ms"))
    return a.unionByName(week_pieces.select(*keys, "week", F.lit(0).cast("long").alias("play_count"), F.col("ms").alias("total_ms")))
