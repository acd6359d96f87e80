"""Top-k search against brute force, whatever pruning is chosen."""

import math
import random

import numpy as np
import pytest

from playtide.llm import norm_search as ns

SCHEMA = "vec_id long, embedding array<float>, score string, id string, label int"


def brute(rows, k, every):
    z = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        z[i] = min(z[i], x) if i in z else x
    out = set()
    for q in (i for i in z if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(z[q], z[c], strict=False)), c) for c in z if c != q)
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)}
    return out


def found(spark, rows, k=5, every=3, cells=ns.BLOCK_CELLS):
    v = ns.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    return {tuple(r) for r in ns.top_k(v, v.where(f"id % {every} = 0"), k, cells).collect()}


def skewed(rng, n, dim=8):
    """Lengths over several orders, clusters, a third equal vectors."""
    rows = []
    for i in range(n):
        scale = 2.0 ** rng.randint(-6, 5)
        v = [1.5] * dim if i % 3 == 0 else [rng.gauss(0, 1) * scale for _ in range(dim)]
        if i % 7 == 0:
            v = [0.01 * rng.gauss(0, 1)] * (dim - 1) + [float(rng.choice([-1, 1])) * scale]
        rows.append((i, v, None, "x", 1))
    return rows


@pytest.mark.parametrize("cells", [ns.BLOCK_CELLS, 40])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(ns, "SEED_ROWS", 20)
    monkeypatch.setattr(ns, "BUCKET_ROWS", 50)
    rows = skewed(random.Random(1), 200)
    assert found(spark, rows, cells=cells, every=3 if cells > 40 else 40) == brute(rows, 5, 3 if cells > 40 else 40)


def test_odd_vectors(spark):
    big = 3.0e30
    rows = [(0, [1.0, 2.0], "s", None, None), (3, None, None, None, None), (6, [1.0, None], None, None, None), (9, [float("nan"), 1.0], None, None, None), (12, [], None, None, None), (15, [0.0, 0.0], None, None, 1),
            (None, [1.0, 1.0], None, None, None), (4, [1.0, 2.0, 3.0], None, None, None), (4, [0.5, 2.0, 3.0], None, None, None), (0, [1.0, 2.0], None, None, None), (18, [float("inf")], None, None, None), (-3, [-1.0, -2.0], None, None, None)]
    assert found(spark, rows) == brute(rows, 5, 3)
    got = {(q, c): s for q, _, c, s in found(spark, [*rows, (21, [big, 0.0], None, None, None), (24, [-big, 0.0], None, None, None)], k=20)}
    assert got[(21, 24)] == -(2**63) and got[(0, 21)] == 2**63 - 1
    assert found(spark, rows[:0]) == set() and found(spark, rows[:1]) == set()


def test_exact_beyond_doubles(spark):
    rows = [(i, [float(2**22 + i), 1.0, float(i)], None, None, None) for i in range(12)]
    assert found(spark, rows) == brute(rows, 5, 3)


def test_every_pruning_is_used():
    """A long first bucket, then short ones: left out, cut by length, cut by coordinates; same rows as a full scan."""
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(900, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    p = np.floor(unit * np.repeat([5000, 4700, 100], 300)[:, None])
    lengths = np.sqrt((p**2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    p, lengths = p[order], lengths[order]
    q = np.floor(256 * np.concatenate([np.eye(6), unit[:20]]))
    best = ns.Best(np.full(len(q), -1), 3, np.full(len(q), ns.LEAST), np.full(len(q), ns.MOST))
    used = {"left_out": 0, "length": 0, "coordinate": 0}
    for at in range(0, 900, 100):
        for name, n in ns.scan_bucket(np.arange(at, at + 100), lengths[at : at + 100], p[at : at + 100], q, np.sqrt((q**2).sum(1)), best).items():
            used[name] += n
    s = (q @ p.T).astype(int)
    want = {(k, i, s[k, i]) for k in range(len(q)) for i in sorted(range(900), key=lambda i: (-s[k, i], i))[:3]}
    assert {(int(k), int(i), int(v)) for k, v, i in zip(*best.rows, strict=True)} == want
    assert all(used.values()) and used["left_out"] > 900 * len(q) // 4
