"""Imports that run again, overlap, repeat records or fail."""

import glob
import os
import uuid

import pytest

from playtide.sources import generations as G
from playtide.sources.staging import import_batch

SCHEMA = "file string, ts long, track string, ms long"


@pytest.fixture
def root(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/imp-{uuid.uuid4().hex}"


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root.removeprefix('file://')}/**/*.parquet", recursive=True)}


def test_imports(spark, root):
    a = [("a", 1, "x", 5), ("a", 1, "x", 5), ("a", 2, None, 5), ("b", 3, "y", None), ("b", None, None, None)]
    b = [("c", 3, "y", None), ("c", 4, "z", 1), ("d", 5, "5", 5), ("e", 2, "", 5)]
    take = lambda rows: import_batch(spark, root, "plays", spark.createDataFrame(rows, SCHEMA))
    counts = lambda i: (i.files, i.known_files, i.records, i.added)
    assert counts(take(a)) == (2, 0, 5, 4)
    before = files(root)
    again = take([("renamed", *r[1:]) for r in reversed(a) if r[0] == "a"] + [r for r in a if r[0] == "b"])
    assert counts(again) == (2, 2, 5, 0) and files(root) == before and again.generation.number == 1
    two = take(b)
    assert counts(two) == (3, 0, 4, 3)
    assert {k: v for k, v in files(root).items() if k in before} == before
    got = [tuple(r) for r in two.generation.read(spark, "plays").select("ts", "track", "ms").collect()]
    assert len(got) == 7 and set(got) == {r[1:] for r in a + b}
    # a file of known records only is taken note of and adds none
    three = take([("f", 4, "z", 1)])
    assert counts(three) == (1, 0, 1, 0) and counts(take([("f", 4, "z", 1)])) == (1, 1, 1, 0)


def test_failed_and_empty_batches(spark, root):
    rows = spark.createDataFrame([("a", 1, "x", 5)], SCHEMA)
    with pytest.raises(G.InvalidGeneration):
        import_batch(spark, root, "plays", rows, validate=lambda shadow: ["no"])
    assert G.current(spark, root) is None
    none = import_batch(spark, root, "plays", rows.limit(0))
    assert (none.files, none.added, none.generation) == (0, 0, None)
    assert import_batch(spark, root, "plays", rows).added == 1
