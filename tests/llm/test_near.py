"""Candidates of near-duplicates: links near the threshold, and texts of one template."""

import random

import numpy as np

from playtide.llm import near_dedup as N
from playtide.llm import shingles as S
from playtide.llm.common import materialize


def fresh(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_links_near_the_threshold(spark):
    """Pairs of a similarity from 0.80 to 0.84, found at a rate of 0.99 or more; below 0.80 never linked."""
    rng, rows, truth = random.Random(1), [], {}
    for k in range(600):
        a = fresh(rng, 120)
        b = a[: 120 - rng.randint(20, 26)]
        x, y = (set(S.shingle_hashes(S.word_hashes(" ".join(t)), 4).tolist()) for t in (a, b))
        truth[k] = 100 * len(x & y) >= 80 * len(x | y)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    linked = {k for k in truth if got[2 * k + 1] == 2 * k}
    want = {k for k, v in truth.items() if v}
    assert 100 < len(want) < 500 and linked <= want and len(linked) >= 0.99 * len(want)


def test_texts_of_one_template_do_not_gather(spark):
    rng = random.Random(2)
    head = fresh(rng, 100)
    docs = spark.createDataFrame([(k, " ".join(head + fresh(rng, 150))) for k in range(2000)], "doc_id long, text string")
    sets = materialize(N.sketches(docs, 4).select(N.F.col("doc_id").alias("node"), "halves"))
    sizes = [r["count"] for r in N.candidate_clusters(sets).groupBy("component").count().collect()]
    assert max(sizes, default=0) <= 20


def test_half_keys_agree_by_similarity():
    rng = np.random.default_rng(3)
    a, b = N._coefficients(2 * N.HALVES * N.ROWS)
    hit = []
    for _ in range(60):
        s = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        x, y = (N.half_keys(v, a, b, N.ROWS) for v in (s[:180], s[20:]))  # 160 of 200 shared
        same = x == y
        hit.append(same[: N.HALVES].any() and same[N.HALVES :].any())
    assert np.mean(hit) >= 0.95
