"""Ambiguous texts, many languages and the score of short texts."""

import random

import numpy as np

from playtide.llm import language_id as L


def speaker(rng, k):
    """Words of an invented language: its own letters weigh most."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [letters[(k * 5 + i * (k % 4 + 1)) % 26] for i in range(9)]
    return lambda n: " ".join("".join(rng.choice(own if rng.random() < 0.75 else letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_twelve_languages(spark):
    rng = random.Random(1)
    speak = {f"l{k:02}": speaker(rng, k) for k in range(12)}
    rows = [(i, speak[lang](rng.randint(5, 60)), lang) for i, lang in enumerate([*speak] * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit(docs)
    assert model["codes"].shape[0] == 12 and model["codes"].shape[1] < 50
    apart = (model["codes"].shape[1] - model["codes"].astype(int) @ model["codes"].T.astype(int)) // 2
    assert (apart + np.eye(12, dtype=int) * 99).min() >= 8
    truth = {r[0]: r[2] for r in rows}
    got = L.predictions(docs.where(L.crc_fold("doc_id") == 0), model).collect()
    right = np.array([r.lang_pred == truth[r.doc_id] for r in got])
    score = np.array([r.score for r in got])
    assert right.mean() >= 0.95 and abs(score.mean() - right.mean()) <= 0.05
    assert np.mean([r.ambiguous for r in got]) <= 0.05


def test_mixed_texts_are_ambiguous(spark):
    rng = random.Random(2)
    speak = {f"l{k}": speaker(rng, k * 3) for k in range(4)}
    rows = [(i, speak[lang](rng.randint(40, 60)), lang) for i, lang in enumerate([*speak] * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit(docs)
    mixed = spark.createDataFrame([(i, " ".join(x + " " + y for x, y in zip(speak["l0"](60).split(), speak["l1"](60).split(), strict=True))) for i in range(40)], "doc_id long, text string")
    assert np.mean([r.ambiguous for r in L.predictions(mixed, model).collect()]) >= 0.5
    assert np.mean([r.ambiguous for r in L.predictions(docs, model).collect()]) <= 0.05
