"""Held-out ranking of the compression classifier against the constant answer."""

import numpy as np

from playtide.llm import queries


def test_ranking_of_held_out_labels(spark):
    small = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None}
    rows = [(label[r.doc_id], r.score) for r in queries.QUERIES["op6_quality_compression"](spark, small).collect() if r.held_out and r.doc_id in label]
    y, s = (np.array(x, float) for x in zip(*rows, strict=True))
    good, bad = s[y == 1], s[y == 0]
    auc = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    assert auc >= 0.95
    assert np.mean((s - y) ** 2) <= 0.5 * np.mean((y.mean() - y) ** 2)
    assert np.mean(bad < 0.3) >= 0.7 and np.mean(good >= 0.3) >= 0.97
