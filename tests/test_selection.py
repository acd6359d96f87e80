"""The varied choice against a greedy pass over all candidates."""

import random
from dataclasses import replace

import pytest

from playtide.operators.selection import Caps, diverse_selection


def greedy(rows, caps):
    best = {}
    for _, _, _, m, _, s in rows:
        best[m] = max(best.get(m, 0), abs(s))
    order = sorted(rows, key=lambda r: (-(round(r[5] / best[r[3]], 9) if best[r[3]] else 0), r[1], r[3], r[0]))
    took = []

    def visit(part, cap):
        for r in part:
            fits = sum(t[1] == r[1] for t in took) < cap and all(t[3] != r[3] for t in took) and (r[4] is None or sum(t[4] == r[4] for t in took) < caps.entity)
            if fits and len(took) < caps.most:
                took.append(r)

    visit([next(r for r in order if r[2] == n) for n in sorted({r[2] for r in order})], caps.category)
    visit(order, caps.category)
    if len(took) < caps.least:
        visit(order, caps.relaxed)
    return [t[0] for t in took]


@pytest.mark.parametrize("caps", [Caps(), Caps(most=5, least=5, category=1, relaxed=4, entity=2)])
def test_against_brute_force(spark, caps):
    rng = random.Random(4)
    rows = []
    for owner in range(30):
        metrics = [(f"m{k}", rng.choice("abc"), rng.choice("xyz")) for k in range(rng.randint(1, 12))]
        for i in range(rng.choice([1, 8, 120])):
            m, c, n = rng.choice(metrics)
            rows.append((owner, f"c{i:03d}", c, n, m, rng.choice([None, "e1", "e1", "e2", "e3"]), float(rng.choice([0, 1, 2, 5, 9]))))
    extra = [(None, "c", "a", "x", "m", "e", 1.0), (1, "z", "a", "x", None, "e", 1.0), (1, "z", "a", "x", "m", "e", None)]
    df = spark.createDataFrame(rows + extra, "owner long, candidate string, category string, narrative string, metric string, entity string, score double")
    got = {}
    for r in sorted(diverse_selection(df, caps).collect(), key=lambda r: (r.owner, r.place)):
        got.setdefault(r.owner, []).append(r.candidate)
    assert got == {o: greedy([r[1:] for r in rows if r[0] == o], caps) for o in range(30)}
    assert diverse_selection(df.limit(0), replace(caps)).count() == 0
