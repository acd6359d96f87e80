"""Importance resampling against brute force, and the draw itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from playtide.llm import importance_resampling as ir


def brute(docs, target, max_n, buckets, min_words, percent, seed):
    def feats(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    cut = [feats(t) for _, t in docs]
    s, t = Counter(b for _, f in cut for b in f), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for k, ((i, _), (n, f)) in enumerate(zip(docs, cut, strict=True)):
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(f), weight, score, None, k])
    fit = sorted((r for r in rows if r[1] >= min_words and r[4] is not None), key=lambda r: (-r[4], r[0], r[6]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = rank
    return sorted((r[:6] for r in rows), key=str)


@pytest.mark.parametrize(("max_n", "buckets", "min_words", "percent"), [(1, 10_000, 20, 10), (3, 50, 5, 50), (2, 7, 0, 100)])
def test_against_brute_force(spark, odd_docs, tiny_docs, small, max_n, buckets, min_words, percent):
    docs = odd_docs.select("doc_id", "text").union(tiny_docs.select("doc_id", "text").limit(60)).coalesce(1)
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [r.text for r in target.collect()], max_n, buckets, min_words, percent, 7)
    got = ir.resample(docs, target, "doc_id", max_n, buckets, 7, min_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(([*r] for r in got.collect()), key=str) == want


def test_ranks_follow_the_target(spark):
    """Documents in the target's words come first by weight; ranks have no gaps and stop at the share."""
    good, other = "solve the equation for x and prove it", "buy cheap watches now and win money"
    docs = spark.createDataFrame([(i, ((good if i % 10 == 0 else other) + " ") * 40) for i in range(500)], "doc_id long, text string")
    target = spark.createDataFrame([(good,)] * 20, "text string")
    got = [r for r in ir.resample(docs, target, "doc_id", max_n=2).collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in got) == list(range(1, 51)) and sum(r.doc_id % 10 == 0 for r in got) == 50


def test_empty_tables(spark, odd_docs):
    none = odd_docs.limit(0)
    assert ir.resample(none, odd_docs, "doc_id").count() == 0
    got = ir.resample(odd_docs, none, "doc_id").collect()
    assert len(got) == odd_docs.count() and all(r.score is None and r["rank"] is None for r in got if r.doc_id is None)
    assert all(r.weight == 0 and r.n_features == 0 for r in got if r.doc_id in (1, 2, 3))
