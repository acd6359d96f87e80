"""Snapshot differences, platform classes and places in one order."""

import pytest
from pyspark.sql import functions as F

from playtide.functions.text import platform_class
from playtide.operators import changes as X
from playtide.operators.ranking import numbered

ROWS = "play_id long, end_us long"


@pytest.mark.parametrize(("old", "new", "kind"), [
    ([], [], "identical"), ([1, 2], [1, 2], "identical"), ([1, 2], [1, 2, 3], "tail"), ([2, 3], [1, 2, 3], "superset"), ([1, 2], [2], "subset"), ([1], [], "subset"), ([1], [2], "disjoint"), ([1, 2], [2, 3], "mixed"),
])
def test_relation(spark, old, new, kind):
    a, b = (spark.createDataFrame([(i, 10 * i) for i in x], ROWS) for x in (old, new))
    assert X.relation(X.difference(a, b, "play_id", "end_us")).first()["relation"] == kind


def test_closure_takes_whole_runs(spark):
    runs = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 1)], "play_id long, user_id long, run_no long")
    a, b = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], ROWS), spark.createDataFrame([(1, 11), (3, 30), (4, 40)], ROWS)
    changed = X.changed_keys(X.difference(a, b, "play_id", "end_us"), "play_id")
    assert sorted(r.play_id for r in X.closure(runs, changed).collect()) == [1, 2]
    assert X.closure(runs, changed.limit(0)).count() == 0


def test_platform_class(spark):
    given = [(None, "unknown"), ("", "unknown"), ("iOS 15.5", "ios"), ("OSX 14", "osx"), ("Windows 10", "windows"), ("Android OS", "android"), ("web_player", "web"), ("toaster", "other"), ("darwin", "windows")]
    got = spark.createDataFrame(given, "raw string, kind string").where(~platform_class(F.col("raw")).eqNullSafe(F.col("kind")))
    assert got.collect() == []


def test_numbered_over_many_ranges(spark):
    df = spark.range(1000, numPartitions=7).select(F.col("id"), (F.col("id") % 5).alias("k"))
    got = numbered(df, "place", F.desc("k"), F.asc("id")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001))
    assert [(r.k, r.id) for r in got] == sorted(((i % 5, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), "place", F.asc("id")).count() == 0
