"""Runs that an edit of the plays can change, and the recalculation of these alone.

Whether a row continues the run of the row before it depends on these two rows only.  An
added, removed or changed row therefore touches the run that it stands in or behind and the
one that begins after it; the chain back from it ends where that run began.  These runs are
found among the published ones by two scans, together with the run before each as context
for its first row, and only their rows are put in order again.  No task holds a listener.

A run is named by its first row (start_us, start_id), so that untouched runs keep their
names.  Rows without a stop time are runs of their own at ``NO_TIME``; rows without a
listener or an id take no part.  ``play_id`` tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.config import US_PER_MS, PlayFilters
from playtide.operators.scans import carried, preceding
from playtide.sources.publish import scratch

#: The place in the order of rows without a stop time.
NO_TIME = -(1 << 62)
RUN = ("user_id", "start_us", "start_id")


def _placed(plays: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """play_id, user_id, at, begin, same: what the rule looks at."""
    at = F.coalesce("end_us", F.lit(NO_TIME))
    ms = F.greatest(F.coalesce("ms", F.lit(0)), F.lit(0)).cast("long")
    kept = plays.where("user_id is not null and play_id is not null")
    return kept.select("play_id", "user_id", at.alias("at"), (at - ms * US_PER_MS).alias("begin"), F.struct(*identity).alias("same"))


def _runs(placed: DataFrame, cfg: PlayFilters, forced: Column) -> DataFrame:
    order = [F.col("at").asc(), F.col("play_id").asc()]
    known = preceding(placed, F.struct("at", "same"), "_before", "user_id", *order)
    gap = F.col("begin") - F.col("_before.at")
    fresh = (
        forced | F.col("_before").isNull() | (F.col("at") == NO_TIME) | (F.col("_before.at") == NO_TIME) | ~F.col("same").eqNullSafe(F.col("_before.same"))
        | (gap > cfg.max_gap_minutes * 60_000_000) | (gap < -cfg.overlap_tolerance_us)
    )
    start = F.when(fresh, F.struct(F.col("at").alias("us"), F.col("play_id").alias("id")))
    named = carried(known.withColumn("_start", start), F.col("_start"), "_run", "user_id", *order)
    return named.select("play_id", "user_id", "at", F.col("_run.us").alias("start_us"), F.col("_run.id").alias("start_id"))


def run_names(plays: DataFrame, cfg: PlayFilters, identity: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """play_id, user_id, at, start_us, start_id of every row of ``plays`` (play_id, user_id, end_us, ms, identity)."""
    return _runs(_placed(plays, identity), cfg, F.lit(False))


def edits(old: DataFrame, new: DataFrame, identity: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """play_id, user_id, at of the places where rows were added, removed or changed: a changed row's old and new one."""
    sides = [_placed(df, identity).select("play_id", F.struct("user_id", "at", "begin", "same").alias(side)) for df, side in ((old, "o"), (new, "n"))]
    changed = sides[0].join(sides[1], "play_id", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    places = changed.select("play_id", F.explode(F.array("o", "n")).alias("p")).where("p is not null")
    return places.select("play_id", "p.user_id", "p.at").distinct()


def _near(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` (user_id, at, play_id) with ``previous``, the last run that starts up to there, and ``following``, the first beyond."""
    run = F.struct(F.col("start_us").alias("us"), F.col("start_id").alias("id"))
    marks = runs.select("user_id", F.col("start_us").alias("at"), F.col("start_id").alias("play_id"), F.lit(0).alias("_ask"), run.alias("_run"))
    asks = points.select("user_id", "at", "play_id", F.lit(1).alias("_ask"), F.lit(None).cast(marks.schema["_run"].dataType).alias("_run"))
    back = carried(marks.union(asks), F.col("_run"), "previous", "user_id", F.asc("at"), F.asc("play_id"), F.asc("_ask"))
    both = carried(back, F.col("_run"), "following", "user_id", F.desc("at"), F.desc("play_id"), F.desc("_ask"), down=True)
    return both.where("_ask = 1").select("user_id", "at", "play_id", "previous", "following")


def touched_runs(old_runs: DataFrame, places: DataFrame) -> DataFrame:
    """user_id, start_us, start_id, context of the old runs that edits touch; with ``context`` only the run before such a one."""
    runs = scratch(old_runs.select(*RUN).distinct())
    near = _near(places.select("user_id", "at", "play_id"), runs)
    hit = scratch(near.select("user_id", F.explode(F.array("previous", "following")).alias("r")).where("r is not null").select("user_id", "r.us", "r.id").distinct())
    earlier = _near(hit.select("user_id", F.col("us").alias("at"), (F.col("id") - 1).alias("play_id")), runs).where("previous is not null")
    both = hit.withColumn("context", F.lit(False)).union(earlier.select("user_id", "previous.us", "previous.id", F.lit(True)))
    return both.groupBy("user_id", F.col("us").alias("start_us"), F.col("id").alias("start_id")).agg(F.min("context").alias("context"))


def recalculated_runs(old_runs: DataFrame, old: DataFrame, new: DataFrame, cfg: PlayFilters, identity: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Runs of ``new`` as ``run_names`` gives them, from ``old_runs`` of ``old``; rows of touched runs only are put in order again.

    ``again`` marks the rows that were.
    """
    places = scratch(edits(old, new, identity))
    changed = places.select("play_id").distinct()
    touched = scratch(touched_runs(old_runs, places))
    member = scratch(old_runs.join(touched, [*RUN]).join(changed, "play_id", "left_anti"))
    # a context run's first row is a start whatever now stands before it among these rows
    rows = _placed(new, identity)
    held = rows.join(member.select("play_id", "context", (F.col("play_id") == F.col("start_id")).alias("_first")), "play_id")
    fresh = rows.join(changed, "play_id", "left_semi").withColumns({"context": F.lit(False), "_first": F.lit(False)})
    again = scratch(held.unionByName(fresh))
    named = _runs(again, cfg, F.col("context") & F.col("_first"))
    done = named.join(again.where(~F.col("context")).select("play_id"), "play_id", "left_semi").withColumn("again", F.lit(True))
    gone = touched.where(~F.col("context")).select(*RUN)
    kept = old_runs.join(gone, [*RUN], "left_anti").join(changed, "play_id", "left_anti").withColumn("again", F.lit(False))
    columns = ["play_id", "user_id", "at", "start_us", "start_id", "again"]
    return kept.select(columns).union(done.select(columns))
