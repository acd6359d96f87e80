"""What a new import changes: differences of two snapshots, their relation and the runs to recalculate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """key, old_at, new_at: a full join of two snapshots; a side that lacks the row is null."""
    a = old.select(key, F.col(at).alias("old_at"))
    b = new.select(key, F.col(at).alias("new_at"))
    return a.join(b, key, "full")


def changed_keys(diff: DataFrame, key: str) -> DataFrame:
    """Keys of added, removed and moved rows."""
    return diff.where(~F.col("old_at").eqNullSafe(F.col("new_at"))).select(key)


def closure(run_rows: DataFrame, changed: DataFrame, key: str = "play_id", listener: str = "user_id") -> DataFrame:
    """All rows of the runs that hold a row of ``changed``: a run is recalculated whole or not at all."""
    touched = run_rows.join(changed, key, "left_semi").select(listener, "run_no").distinct()
    return run_rows.join(touched, [listener, "run_no"], "left_semi")


def relation(diff: DataFrame) -> DataFrame:
    """One row: added, removed, unchanged and how the new snapshot relates to the old one.

    An empty new snapshot is a subset, two empty ones are identical; rows that are added only
    behind the last old row are a tail, which is appended without a rebuild.
    """
    only_new, only_old = F.col("old_at").isNull(), F.col("new_at").isNull()
    n = diff.agg(
        F.count_if(only_new).alias("added"), F.count_if(only_old).alias("removed"), F.count_if(~only_new & ~only_old).alias("unchanged"),
        F.min(F.when(only_new, F.col("new_at"))).alias("first_new"), F.max("old_at").alias("last_old"),
    )
    added, removed = F.col("added") > 0, F.col("removed") > 0
    kind = (
        F.when(~added & ~removed, "identical").when(~removed & (F.col("first_new") >= F.col("last_old")), "tail").when(~removed, "superset")
        .when(~added, "subset").when(F.col("unchanged") == 0, "disjoint").otherwise("mixed")
    )
    return n.select("added", "removed", "unchanged", kind.alias("relation"))


def covers(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """One row: whether the time range of ``new`` holds that of ``old``; an empty ``old`` is covered, an empty ``new`` covers nothing else."""
    ends = lambda df, p: df.agg(F.min(at).alias(f"{p}_first"), F.max(at).alias(f"{p}_last"))
    held = (F.col("new_first") <= F.col("old_first")) & (F.col("new_last") >= F.col("old_last"))
    return ends(old, "old").crossJoin(ends(new, "new")).withColumn("covers", F.col("old_first").isNull() | F.coalesce(held, F.lit(False)))
