"""Span folds against plain loops, and texts with very many matches."""

import random
import time

import numpy as np
import pytest

from playtide.llm import pii, secret_scan
from playtide.llm.spans import SPAN, best_apart, distinct_spans, free_of, redacted


def spans(rng, n, wide=40):
    out = [(a, rng.randrange(4), a + rng.randint(1, 6), "k", "m") for a in (rng.randrange(wide) for _ in range(n))]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 3])
def test_folds(spark, monkeypatch, block):
    from playtide.llm import spans as sp

    monkeypatch.setattr(sp, "BLOCK", block)
    rng, rows = random.Random(1), []
    for i in range(80):
        n = rng.choice([0, 1, 5, 20])
        rows.append((i, "".join(rng.choice("abcé漢") for _ in range(50)), spans(rng, n), spans(rng, rng.choice([0, 2, 9])), [(rng.randrange(3) / 2, s) for s in spans(rng, n)]))
    df = spark.createDataFrame(rows, f"i int, t string, a {SPAN}, b {SPAN}, w array<struct<p:double,s:struct<start:int,rank:int,end:int,kind:string,match:string>>>")
    got = df.select("i", free_of(df.a, df.b).alias("free"), distinct_spans(df.a).alias("once"), redacted(df.t, df.a, "#").alias("red"), best_apart(df.w).alias("best")).collect()
    meet = lambda x, y: x[0] < y[2] and y[0] < x[2]
    for r in got:
        _, t, a, b, w = rows[r.i]
        assert sorted(tuple(x) for x in r.free) == [x for x in a if not any(meet(x, y) for y in b)]
        assert [tuple(x) for x in r.once] == sorted(set(a))
        kept = []
        for _, s in sorted(w, key=lambda x: (-x[0], x[1])):
            if not any(meet(s, k) for k in kept):
                kept.append(s)
        assert sorted(tuple(x) for x in r.best) == sorted(kept)
        out, at = "", 0
        for s in a:
            if s[0] >= at:
                out += t[at : s[0]] + "#"
            at = max(at, s[2])
        assert r.red == out + t[at:]


def test_a_hundred_thousand_matches(spark):
    """One text of 100,000 secrets is scanned and redacted in seconds, and the base spans of as many addresses are found."""
    hexes = " ".join(f"{i:024x}" for i in range(100_000))
    docs = spark.createDataFrame([(1, hexes)], "doc_id long, text string")
    model = secret_scan.train(spark.createDataFrame([(1, "plain words " * 50)], "doc_id long, text string"))
    began = time.time()
    out = secret_scan.redact_secrets(docs, model).first().text
    assert out == " ".join([secret_scan.MARK] * 100_000) and time.time() - began < 30
    mails = spark.createDataFrame([(1, " ".join(f"a{i}@b.org" for i in range(100_000)))], "doc_id long, text string")
    began = time.time()
    found = mails.select(pii.base_spans(mails.text).alias("s")).first().s
    assert len(found) == 100_000 and all(s.match == f"a{i}@b.org" for i, s in enumerate(found)) and time.time() - began < 30


def test_cutoff_takes_equal_scores_together():
    score, y = np.repeat([3.0, 2.0, 1.0], 100), np.r_[np.ones(100), np.tile([1, 1, 1, 0], 25), np.ones(100)]
    assert pii.cutoff(score, y, 0.95, 0.05) == pytest.approx(3.0) and pii.cutoff(score, y, 0.8, 0.05) == pytest.approx(1.0)
    assert pii.cutoff(score, y * 0, 0.5, 0.05) == float("inf") and pii.cutoff(score[:10], y[:10], 0.95, 0.05) == float("inf")
    assert pii.at_least(8, 10, 0.5) == pytest.approx(56 / 1024) and pii.at_least(0, 5, 0.3) == pytest.approx(1)


def test_precision_on_lines_that_nothing_was_fitted_to(spark):
    model = pii.train(spark)
    assert all(p is None or p >= 0.95 for p in model["precision"].values()) and sum(p is not None for p in model["precision"].values()) >= 3
