"""Streams over a folder of files that are not in the order of time."""

import duckdb
import pytest
from pyspark.sql import functions as F

from playtide.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    """The events dealt out to files by a hash, so that every file spans the whole time."""
    folder = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{small}/events.parquet").repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_open_windows", "stream_sessions", "stream_type_runs"])
def test_files_in_any_order(spark, shuffled, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{shuffled}/events.parquet/*.parquet'")
    ours, theirs = QUERIES[name](spark, shuffled), c.execute(ORACLES[name])
    names = [x[0] for x in theirs.description]
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(theirs.fetchall())
