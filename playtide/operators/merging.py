"""Merge groups in a total order of evidence that keep forbidden pairs apart.

Edges are taken from the strongest to the weakest.  An edge joins the groups of its ends
unless the two hold a forbidden pair between them; then it is refused, for good, since
groups only grow.  The outcome depends on the order, so it is the sequential one, found
in rounds without one task that holds everything:

* edges inside a group and edges between groups with a forbidden pair are decided and go;
  of several edges between two groups only the first counts;
* the components of the remaining edges cannot influence each other.  One without a
  forbidden pair inside is joined whole, whatever the order.  One with up to ``TASK_ROWS``
  edges and forbidden pairs is decided in order inside a task, many such in one;
* if larger components with forbidden pairs remain, the next round looks at the first half
  of their edges only.  No edge that comes later can touch what these decide, so this is
  exact; the halves end when components are small enough.

A refused edge ends in two groups and an accepted one in one, so the decisions can be
read off the groups.  Defined cases: edges and forbidden pairs of a node with itself,
with a null end or a null rank are ignored, repeated ones count once; forbidden pairs of
nodes without edges have no effect; no edges give no groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.operators.identity import connected
from playtide.sources.publish import scratch

#: Edges and forbidden pairs of conflicting components that one task decides.
TASK_ROWS = 100_000


def decide(edges: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
    """node, group of the edges (rank, a, b), taken by rank, with forbidden pairs (a, b)."""
    parent: dict[int, int] = {}
    enemies: dict[int, set[int]] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(bad["a"].tolist(), bad["b"].tolist(), strict=True):
        enemies.setdefault(a, set()).add(b)
        enemies.setdefault(b, set()).add(a)
    ordered = edges.sort_values("rank")
    for a, b in zip(ordered["a"].tolist(), ordered["b"].tolist(), strict=True):
        low, high = sorted((find(a), find(b)))
        if low == high or high in enemies.get(low, ()):
            continue
        parent[high] = low
        for other in enemies.pop(high, ()):
            enemies[other].discard(high)
            enemies[other].add(low)
            enemies.setdefault(low, set()).add(other)
    return pd.DataFrame({"node": list(parent), "group": [find(x) for x in parent]}, dtype="int64")


def _moved(df: DataFrame, moves: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        to = moves.select(F.col("node").alias("_node"), F.col("group").alias("_group"))
        df = df.join(to, df[c] == F.col("_node"), "left").withColumn(c, F.coalesce("_group", c)).drop("_node", "_group")
    return df


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def constrained_groups(edges: DataFrame, forbidden: DataFrame, task_rows: int = TASK_ROWS, max_rounds: int = 200) -> DataFrame:
    """node, group (its smallest node) of the nodes of ``edges`` (rank, src, dst; rank tells edges apart) with ``forbidden`` (src, dst)."""
    pending = scratch(edges.where("src <> dst and rank is not null").select("rank", *_ordered("src", "dst")))
    bad = scratch(forbidden.where("src <> dst").select(*_ordered("src", "dst")).distinct())
    labels = scratch(pending.select(F.col("a").alias("node")).union(pending.select("b")).distinct().withColumn("group", F.col("node")))
    cuts: list[int | None] = [None]  # the innermost half last
    for _ in range(max_rounds):
        cut = cuts[-1]
        open_edges = pending.where("a <> b").groupBy("a", "b").agg(F.min("rank").alias("rank"))
        pending = scratch(open_edges.join(bad, ["a", "b"], "left_anti"))
        active = pending if cut is None else pending.where(F.col("rank") <= cut)
        if not active.limit(1).count():
            cuts.pop()
            if not cuts:
                return labels
            continue
        found = connected(active.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        of = lambda side, found=found: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        inside = scratch(bad.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select(F.col("ca").alias("component"), "a", "b"))
        held = scratch(active.join(of("a"), "a").select(F.col("ca").alias("component"), "rank", "a", "b"))
        conflicts = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n_bad"))
        sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(conflicts, "component", "left")
        sizes = scratch(sizes.select("component", F.col("n_bad").isNull().alias("free"), (F.col("n") + F.coalesce("n_bad", F.lit(0))).alias("rows")))
        fits = F.col("rows") <= task_rows
        small = sizes.where(~F.col("free") & fits)
        waiting = held.join(sizes.where(~F.col("free") & ~fits), "component", "left_semi")
        buckets = 1 + (small.agg(F.sum("rows")).first()[0] or 0) // task_rows
        by = F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")
        dealt = lambda df, small=small, by=by: df.join(small, "component", "left_semi").withColumn("bucket", by).groupBy("bucket")
        decided = dealt(held).cogroup(dealt(inside)).applyInPandas(decide, "node long, group long")
        whole = found.join(sizes.where("free"), "component", "left_semi").select("node", F.col("component").alias("group"))
        moves = scratch(whole.union(decided).where("node <> group"))
        pending = _moved(pending, moves, "a", "b").select("rank", *_ordered("a", "b"))
        bad = scratch(_moved(bad, moves, "a", "b").where("a <> b").select(*_ordered("a", "b")).distinct())
        labels = scratch(_moved(labels, moves, "group"))
        half = waiting.agg(F.percentile_approx("rank", 0.5)).first()[0]
        if half is not None:
            cuts.append(half)
    raise RuntimeError("merge groups did not settle")


def merge_decisions(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``edges`` with ``accepted``: both ends came into one group."""
    of = lambda side: groups.select(F.col("node").alias(f"_{side}"), F.col("group").alias(f"_g{side}"))
    both = edges.join(of("src"), F.col("src") == F.col("_src"), "left").join(of("dst"), F.col("dst") == F.col("_dst"), "left")
    return both.withColumn("accepted", (F.col("src") == F.col("dst")) | F.coalesce(F.col("_gsrc") == F.col("_gdst"), F.lit(False))).drop("_src", "_gsrc", "_dst", "_gdst")
