"""Merge groups with forbidden pairs against edges taken one after another."""

import random

import pytest
from pyspark.sql import functions as F

from playtide.operators.merging import constrained_groups, merge_decisions


def sequential(edges, forbidden):
    """Smallest node of each node's group, by comparing whole member sets."""
    groups = {x: {x} for e in edges for x in e[1:]}
    bad = {frozenset(p) for p in forbidden}
    for _, a, b in sorted(edges):
        left, right = groups[a], groups[b]
        if left is right or any(frozenset((x, y)) in bad for x in left for y in right):
            continue
        left |= right
        for x in right:
            groups[x] = left
    return {x: min(g) for x, g in groups.items()}


@pytest.mark.parametrize(("seed", "nodes", "n_edges", "n_bad", "task_rows"), [(1, 60, 80, 25, 100_000), (2, 60, 120, 60, 40), (3, 200, 260, 4, 150)])
def test_random_graphs(spark, seed, nodes, n_edges, n_bad, task_rows):
    rng = random.Random(seed)
    edges = [(k, rng.randrange(nodes), rng.randrange(nodes)) for k in range(n_edges)]
    forbidden = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n_bad)]
    e, b = spark.createDataFrame(edges, "rank long, src long, dst long"), spark.createDataFrame(forbidden, "src long, dst long")
    got = {r.node: r.group for r in constrained_groups(e, b, task_rows).collect()}
    clean = [x for x in edges if x[1] != x[2]]
    want = sequential(clean, [p for p in forbidden if p[0] != p[1]])
    assert got == want
    groups = spark.createDataFrame(list(got.items()), "node long, group long")
    accepted = {r["rank"]: r.accepted for r in merge_decisions(e, groups).collect()}
    assert accepted == {k: a == b or want[a] == want[b] for k, a, b in edges}


def test_long_chain_with_forbidden_ends(spark):
    """A path in order whose ends must stay apart is cut at its last edge, also in tasks of few rows."""
    n = 24
    edges = spark.range(n).select(F.col("id").alias("rank"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.node: r.group for r in constrained_groups(edges, spark.createDataFrame([(0, n)], "src long, dst long"), 12).collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n}


def test_nulls_and_empty_tables(spark):
    edges = spark.createDataFrame([(1, 5, 6), (None, 6, 7), (2, 7, None), (3, 8, 8)], "rank long, src long, dst long")
    none = spark.createDataFrame([], "src long, dst long")
    assert {r.node: r.group for r in constrained_groups(edges, none).collect()} == {5: 5, 6: 5}
    assert constrained_groups(edges.limit(0), none).count() == 0
    assert {r.node: r.group for r in constrained_groups(edges, spark.createDataFrame([(6, 5), (None, 5)], "src long, dst long")).collect()} == {5: 5, 6: 6}
