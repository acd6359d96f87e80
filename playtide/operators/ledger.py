"""The weekly ledger of charts as a published generation: validity, week replacement, raw fallback.

The ledger holds, for tracks, albums and artists, plays and time of every entity and week,
``weeks_a_part`` weeks to a part.  It is valid for the chart rules and the plays that it was made from.
With new plays only the parts of changed weeks are made anew, in a shadow whose totals must equal
those of the plays before it becomes current; with other rules the whole ledger is.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import ChartConfig
from playtide.functions.timefns import week_no
from playtide.operators.charts import weekly_totals
from playtide.sources import generations as G

KINDS = ("track", "album", "artist")


#: Weeks that share the files of a part.
WEEKS_A_PART = 13


def params(cfg: ChartConfig, weeks_a_part: int = WEEKS_A_PART) -> dict:
    """The rules that the ledger depends on; the size of the chart is none."""
    return {"ledger": "weekly", "version": 1, "weeks_a_part": weeks_a_part} | {k: v for k, v in asdict(cfg).items() if k != "top_n"}


def _part(week: Column, weeks_a_part: int) -> Column:
    return F.floor(week / (7 * weeks_a_part)).cast("long")


def _totals(plays: DataFrame, cfg: ChartConfig, weeks_a_part: int) -> dict[str, tuple[DataFrame, str]]:
    return {k: (weekly_totals(plays, f"{k}_id", cfg).withColumn("part", _part(F.col("week"), weeks_a_part)), "part") for k in KINDS}


def changed_weeks(old: DataFrame, new: DataFrame, cfg: ChartConfig) -> DataFrame:
    """(week) whose plays differ, by row count and the sum of row hashes of each week."""
    def sums(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
        week = week_no(F.col("end_us"), cfg.week_start_dow, cfg.week_start_hour)
        return df.groupBy(week.alias("week")).agg(F.struct(F.count(F.lit(1)), F.sum(row)).alias(name))

    return sums(old, "o").join(sums(new, "n"), "week", "full").where(~F.col("o").eqNullSafe(F.col("n")) & F.col("week").isNotNull()).select("week")


def refresh(spark: SparkSession, root: str, plays: DataFrame, cfg: ChartConfig, changed: DataFrame | None = None, weeks_a_part: int = WEEKS_A_PART) -> G.Generation:
    """The valid generation for ``plays``; ``changed`` (week) are the weeks that differ from the current one's plays.

    A valid one is returned as it is.  Without ``changed``, or if the current one has other rules, all weeks are made.
    """
    rules, source = params(cfg, weeks_a_part), G.source_hash(plays)
    now = G.current(spark, root)
    if now and now.params == G.params_hash(rules) and now.source == source:
        return now
    kept = now if now and now.params == G.params_hash(rules) and changed is not None else None
    rows, parts = plays, None
    if kept:
        parts = [r.part for r in changed.select(_part(F.col("week"), weeks_a_part).alias("part")).distinct().collect()]  # spans of the calendar
        rows = plays.where(_part(week_no(F.col("end_us"), cfg.week_start_dow, cfg.week_start_hour), weeks_a_part).isin(parts))
    expected = plays.agg(F.coalesce(F.sum("plays"), F.lit(0)), F.coalesce(F.sum("ms"), F.lit(0)))

    def validate(shadow: G.Generation) -> list[str]:
        want = tuple(expected.first())
        found = {k: tuple(shadow.read(spark, k).agg(F.coalesce(F.sum("plays"), F.lit(0)), F.coalesce(F.sum("ms"), F.lit(0))).first()) for k in KINDS}
        return [f"{k}: plays and time {v}, of {want}" for k, v in found.items() if v != want]

    return G.publish(spark, root, _totals(rows, cfg, weeks_a_part), rules, source, base=kept, replaced=dict.fromkeys(KINDS, parts) if kept else None, validate=validate)


def weekly(spark: SparkSession, root: str, plays: DataFrame, kind: str, cfg: ChartConfig, weeks_a_part: int = WEEKS_A_PART) -> DataFrame:
    """entity, week, plays, ms from a valid ledger, else from the plays."""
    found = G.served(spark, root, kind, params(cfg, weeks_a_part), G.source_hash(plays), lambda: weekly_totals(plays, f"{kind}_id", cfg))
    return found.select("entity", "week", "plays", "ms")
