"""Hilbert shards against brute force, and pruning of the files on every dimension."""

from bisect import bisect_right
from collections import Counter

from pyspark.sql import functions as F

from playtide.llm import hilbert_sharding as H
from playtide.llm.common import materialize

DIMS = ["lang", "source", "size"]


def steps(values):
    """Value -> equal-fill step, from the counts of the distinct values; nulls first."""
    count, before, out = Counter(values), 0, {}
    for v in sorted(count, key=lambda v: (v is not None, v)):
        out[v] = min(int((before + count[v] / 2) * 2**H.BITS // len(values)), 2**H.BITS - 1)
        before += count[v]
    return out


def test_against_brute_force(spark, tiny_docs):
    meta = H.metadata(tiny_docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(H.SALTS)))
    rows = meta.collect()
    step = {d: steps([r[d] for r in rows]) for d in DIMS}
    place = sorted((H.curve_index(tuple(step[d][r[d]] for d in DIMS), H.BITS), r.salt, r.doc_id) for r in rows)
    small, extra = divmod(len(rows), 16)
    starts = [k * small + min(k, extra) for k in range(16)]
    want = {}
    for rank, (_, _, doc) in enumerate(place):
        shard = bisect_right(starts, rank) - 1
        want[doc] = (shard, rank - starts[shard])
    got = {r.doc_id: (r.shard, r.slot) for r in H.hilbert_shards(materialize(H.metadata(tiny_docs)), DIMS, "doc_id").collect()}
    assert got == want


def test_curve_visits_neighbours():
    at = {H.curve_index((x, y, z), 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1], strict=True)) == 1 for k in range(511))


def test_files_are_pruned_on_every_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = H.hilbert_shards(materialize(H.metadata(docs)), DIMS, "doc_id")
    boxes = out.groupBy("shard").agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max))]).collect()
    values = {d: [r[d] for r in out.select(d).collect() if r[d] is not None] for d in DIMS}
    for d in DIMS:
        for v in (min(values[d]), max(values[d])):
            assert sum(b[f"low_{d}"] <= v <= b[f"high_{d}"] for b in boxes if b[f"low_{d}"] is not None) <= 12, (d, v)
    v = sorted(values["size"])[len(values["size"]) // 2]
    read = sum(b.low_size <= v <= b.high_size and b.low_lang <= "en" <= b.high_lang for b in boxes if b.low_lang is not None)
    assert read <= 8
