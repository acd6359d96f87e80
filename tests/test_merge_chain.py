"""Runs after random edits equal those of a whole recalculation; scans equal windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.config import PlayFilters
from playtide.operators import merge_chain as M
from playtide.operators import scans
from playtide.operators.timeline import runs

SCHEMA = "play_id long, user_id long, end_us long, ms long, track_id long"
CFG = PlayFilters()


def plays(rng, n, users):
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 30, 60, 60, 60, 400, 1000]) * 1_000_000
        rows.append([i * 10, rng.randrange(users), None if rng.random() < 0.03 else at, rng.choice([60_000, 30_000, 0, None]), rng.choice([1, 1, 1, 2, None])])
    return rows


def edited(rng, rows):
    out = [list(r) for r in rows if rng.random() > 0.08]
    for r in out:
        if rng.random() < 0.05:
            r[rng.choice([1, 2, 3, 4])] = rng.choice([0, 1, 5_000_000, 90_000_000])
    for k in range(12):
        src = rng.choice(rows)
        out.append([100_000 + k, src[1], (src[2] or 0) + rng.choice([-30, 0, 30]) * 1_000_000, 30_000, src[4]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    rng = random.Random(seed)
    old_rows = plays(rng, 160, 2)
    new_rows = edited(rng, old_rows)
    old, new = spark.createDataFrame(old_rows, SCHEMA), spark.createDataFrame(new_rows, SCHEMA)
    got = {(r.play_id, r.start_us, r.start_id) for r in M.recalculated_runs(M.scratch(M.run_names(old, CFG)), old, new, CFG).collect()}
    assert len(got) == len(new_rows)
    assert got == {(r.play_id, r.start_us, r.start_id) for r in M.run_names(new, CFG).collect()}


def test_names_agree_with_the_timeline(spark):
    """Same partition of rows into runs as the window over a listener gives."""
    df = spark.createDataFrame([r for r in plays(random.Random(5), 200, 3) if r[2] is not None], SCHEMA)
    numbers = {r.play_id: (r.user_id, r.run_no) for r in runs(df, CFG).collect()}
    names = {r.play_id: (r.user_id, r.start_us, r.start_id) for r in M.run_names(df, CFG).collect()}
    assert names.keys() == numbers.keys() and len({(names[i], numbers[i]) for i in names}) == len(set(names.values())) == len(set(numbers.values()))


def test_few_rows_are_put_in_order_again(spark):
    """One late row touches the runs beside it, not the listener's others; no edit touches none."""
    old = spark.createDataFrame([(i, 1, i * 3_600_000_000, 1000, 1) for i in range(100)], SCHEMA)
    known = M.scratch(M.run_names(old, CFG))
    new = old.union(spark.createDataFrame([(1000, 1, 50 * 3_600_000_000 + 60_000_000, 1000, 1)], SCHEMA))
    got = M.recalculated_runs(known, old, new, CFG)
    assert {r.play_id for r in got.where("again").collect()} == {50, 1000, 51} and got.count() == 101
    assert M.recalculated_runs(known, old, old, CFG).where("again").count() == 0


def test_scans_equal_windows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k long, v long").repartition(7)
    w = Window.partitionBy("k").orderBy("i")
    want = df.select("i", F.last("v", True).over(w).alias("a"), F.lag("i").over(w).alias("b"), F.max("v").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)).alias("c"), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("d"))
    got = scans.carried(df, F.col("v"), "a", "k", F.asc("i"))
    got = scans.preceding(got, F.col("i"), "b", "k", F.asc("i"))
    got = scans.running_max(got, F.col("v"), "c", F.asc("i"))
    got = scans.carried(got, F.col("v"), "d", "k", F.desc("i"), down=True).select("i", "a", "b", "c", "d")
    assert sorted(got.collect()) == sorted(want.collect())
