"""Shapes of plans on which memory and shuffles at size depend."""

import uuid

from pyspark.sql import functions as F

from playtide.operators import habits as H
from playtide.operators import maintenance
from playtide.operators import panels as P
from playtide.operators import search as se
from playtide.operators.selection import diverse_selection
from playtide.plans import QUERIES
from playtide.sources import publish as publish_
from playtide.sources.plays import chart_plays
from playtide.sources.publish import publish, scratch, shared_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_dealt_once(spark):
    schema = "owner long, candidate string, category string, narrative string, metric string, entity string, score double"
    df = spark.createDataFrame([(1, "c", "a", "n", "m", None, 1.0)], schema)
    text = plan(diverse_selection(df, tasks=7))
    assert text.count("Exchange") == 1 and "hashpartitioning(owner" in text and ", 7)" in text


def test_a_large_part_is_written_by_several_tasks(spark):
    path = f"{shared_dir(spark)}/published/{uuid.uuid4().hex}"
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        publish(spark.range(200_000, numPartitions=8).select(F.lit(1999).alias("year"), F.xxhash64("id").alias("n")), path, "year")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    got = spark.read.parquet(path)
    assert got.count() == 200_000 and len(got.inputFiles()) > 4


def test_ranges_of_the_order_are_bounded(spark, monkeypatch):
    written = []
    scratch = H.scratch
    monkeypatch.setattr(H, "RANGE_ROWS", 50)
    monkeypatch.setattr(H, "scratch", lambda df: written.append(scratch(df)) or written[-1])
    got = H.nth_rows(spark.range(1000).select((F.lit(999) - F.col("id")).alias("at")), ["at"], [1, 2, 500, 1000], 1000)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (1, 2), (499, 500), (999, 1000)]
    assert written[0].groupBy("_part").count().agg(F.max("count")).first()[0] < 200


def test_panel_meets_plays_in_one_join(spark):
    plays = spark.createDataFrame([(1, 10, 1, 1000, 2)], "artist_id long, album_id long, track_id long, day long, plays long")
    text = plan(P.release_panel(plays, spark.createDataFrame([(1, 10, 1000)], "artist_id long, album_id long, arrived long")))
    assert text.count("Join ") == 1


def test_one_reading_of_the_plays(spark, small):
    assert "l_orderkey" not in plan(QUERIES["record_triple_no1"](spark, small))


def test_distinct_counts_expand_no_rows(spark, small):
    assert "Expand" not in plan(QUERIES["feed_personal_weekly"](spark, small))


def test_only_counted_sides_are_broadcast(spark, small, monkeypatch):
    assert plan(chart_plays(spark, small)).count("BroadcastExchange") == 2
    monkeypatch.setattr(publish_, "SIDE_ROWS", 10, raising=False)
    assert "Broadcast" not in plan(chart_plays(spark, small))


def test_releases_and_their_spans_are_not_broadcast(spark):
    plays = scratch(spark.createDataFrame([(1, 10, 1, 1000, 2)], "artist_id long, album_id long, track_id long, day long, plays long"))
    releases = scratch(P.release_tracks(P.track_roles(plays)))
    panel = P.release_panel(plays, releases)
    assert "Broadcast" not in plan(panel)
    text = plan(P.release_impact(panel, releases, plays))
    assert "BroadcastHashJoin" not in text and text.count("BroadcastExchange") == 1  # the span of all days


def test_touched_entities_are_shuffled_beyond_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "track", f"name{i}", None, None, 0) for i in range(50)], "entity long, kind string, label string, secondary string, alias string, popularity long")
    now = maintenance.publish_index(spark, f"{shared_dir(spark)}/index/{uuid.uuid4().hex}", docs, "old")
    monkeypatch.setattr(publish_, "SIDE_ROWS", 3, raising=False)
    joins, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, on=None, how=None: joins.append((on, join(self, other, on, how))) or joins[-1][1])
    now = maintenance.apply_delta(spark, now, docs.where("entity < 5"), docs.where("entity > 45").select("entity"), "new")
    tops = [next(x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x) for on, out in joins if on == "entity"]
    assert len(tops) == 3 and all("SortMergeJoin" in x for x in tops)
    assert sorted(r.entity for r in now.read(spark, "entities").collect()) == list(range(46))


def test_sides_beyond_the_bound_are_shuffled(spark, monkeypatch):
    """A compressed file says little of the rows that are exploded from it: only counted sides are broadcast."""
    monkeypatch.setattr(se, "PROBES", 0, raising=False)
    index = se.build_index(spark.createDataFrame([(1, "track", "abcdef ghi", "jkl", "m", 0), (2, "track", "abcdef", None, "m", 0)], "entity long, kind string, label string, secondary string, alias string, popularity long"))
    queries = se.scratch(spark.createDataFrame([("abcdxf", ["abcdxf"]), ("abcd", ["abcd"]), ("ghi abcdef", ["ghi abcdef", "abcdef ghi"]), ("f gh", ["f gh"]), ("a", ["a"])], "query_id string, variants array<string>"))
    joins, join = [], type(index.entities).join
    monkeypatch.setattr(type(index.entities), "join", lambda self, other, on=None, how=None: joins.append((on, join(self, other, on, how))) or joins[-1][1])
    got = se.search(index, queries)
    monkeypatch.undo()
    top = [(on, next(x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x)) for on, out in joins if isinstance(on, (str, list))]
    # the numbers of the pieces of three characters are few, whatever the words
    broadcast = [on for on, text in top if "SortMergeJoin" not in text]
    assert len(top) >= 12 and broadcast == ["key"] * len(broadcast) and len(broadcast) <= 1
    assert sorted((r.query_id, r.entity, r.tier) for r in got.collect()) == [("a", 1, 1), ("a", 2, 1), ("abcd", 1, 1), ("abcd", 2, 1), ("abcdxf", 1, 1001), ("abcdxf", 2, 1001), ("f gh", 1, 4), ("ghi abcdef", 1, 2)]
