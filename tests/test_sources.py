"""Imports of account exports, published tables and components on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from playtide.operators.identity import connected
from playtide.sources import imports as I
from playtide.sources.publish import publish, replace_parts


def write(folder, name, value):
    (folder / name).write_text(json.dumps(value))
    return f"file://{folder / name}"


def record(ts, track="a", ms=1000):
    return {"ts": ts, "platform": "ios", "ms_played": ms, "master_metadata_track_name": track}


def test_history_drops_exact_repeats(spark, tmp_path):
    write(tmp_path, "h1.json", [record("2024-01-01T00:00:00Z"), record("2024-01-01T00:05:00Z", None)])
    write(tmp_path, "h2.json", [record("2024-01-01T00:00:00Z"), record("not a time")])
    rows = I.streaming_history(spark, f"file://{tmp_path}/h*.json").collect()
    assert len(rows) == 3 and len({r.fingerprint for r in rows}) == 3
    assert sorted(r.end_us is None for r in rows) == [False, False, True]
    assert [r.records for r in I.inventory(spark, f"file://{tmp_path}/h*.json").orderBy("source_file").collect()] == [2, 2]
    write(tmp_path, "h3.json", [record("2024-01-01T00:00:00Z"), record("not a time")])
    assert I.file_manifest(spark, f"file://{tmp_path}/h*.json").groupBy("sha256").count().where("count > 1").count() == 1


def test_malformed_history_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"ts": 1, ')
    with pytest.raises(Exception):  # noqa: B017  the read fails as a whole
        I.streaming_history(spark, f"file://{tmp_path}/bad.json").collect()


def test_library_playlists_searches(spark, tmp_path):
    path = write(tmp_path, "library.json", {"tracks": [{"artist": "x", "track": "t"}], "albums": [], "artists": [{"name": "x"}, {"name": "y"}]})
    assert {k: v.count() for k, v in I.library(spark, path).items()} == {"tracks": 1, "albums": 0, "artists": 2}
    path = write(tmp_path, "lists.json", {"playlists": [{"name": "p", "items": [{"track": {"trackName": "t"}}, {"track": {"trackName": "u"}}]}, {"name": "q", "items": []}]})
    assert [(r.name, r.position, r.trackName) for r in I.playlists(spark, path).orderBy("name", "position").collect()] == [("p", 0, "t"), ("p", 1, "u"), ("q", None, None)]
    path = write(tmp_path, "s.json", [{"platform": "a", "searchTime": t, "searchQuery": q} for t, q in (("2024-01-01T00:00:00Z[UTC]", " Foo"), ("2024-01-01T00:00:00Z[UTC]", "foo "), ("x", "foo"))])
    assert [r.query for r in I.searches(spark, path).collect()] == ["foo"]


def test_inference_rules(spark):
    df = spark.createDataFrame([("1P_Custom",), ("3P_x",), ("Age 20",), ("Rock",), (None,)], "t string")
    assert [r[0] for r in df.select(I.classify_inference(F.col("t"))).collect()] == ["first party", "third party", "demographic", "interest", "interest"]


def test_partial_replacement(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publish(spark.createDataFrame([(1, 10), (2, 20)], "week int, n int"), path, "week")
    replace_parts(spark.createDataFrame([(2, 21), (3, 30)], "week int, n int"), path, "week")
    assert sorted((r.week, r.n) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 21), (3, 30)]


def test_components(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(1000), 60)
    edges = [*zip(nodes[:30], nodes[1:30], strict=False), *[(nodes[30], x) for x in nodes[31:50]], (nodes[50], nodes[51]), (nodes[50], nodes[50])]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: min(part) for part in (nodes[:30], nodes[30:50], nodes[50:52]) for n in part}
    assert connected(spark.createDataFrame([], "src long, dst long")).count() == 0
