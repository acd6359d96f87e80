"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 / -1 bits: all distinct two-way splits for up to
``EXHAUSTIVE`` languages, else the random dense code of the greatest minimum distance.
For each bit a binary classifier over hashed letter bigrams and trigrams says on which
side a text lies.  Its weights are log ratios of the gram frequencies of the two sides
(each language counts alike); its margins are scaled on a validation fold.  Decoding
is loss-weighted: the distance of a text to a language is the sum of the logistic
losses of the bits, weighted by how often each bit is right on that language; the
nearest codeword wins.  The score is the softmax of the distances; its sharpness is set by
the validation fold on fragments of ``FRAGMENT`` characters, which are hard enough to be
mistaken.  A text whose lead over the second codeword is below that of all but
``UNSURE_SHARE`` of the validation texts is flagged as ambiguous.

Bound of the training sample: about ``FIT_ROWS`` rows a language, chosen by a hash of
the id.  The model has ``BUCKETS`` x bits numbers.  Prediction reads whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null
languages and null ids are not learned from; without any learned language every text
is ``und``; with a single one it is predicted with score 1; repeated rows give
repeated rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import crc_fold

BUCKETS = 1 << 15
FIT_ROWS = 2000
EXHAUSTIVE = 7
FRAGMENT, UNSURE_SHARE = 30, 0.005
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Buckets of the letter bigrams and trigrams; other characters are one kind of gap."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c >= 0xAA) & ((c < 0x2000) | (c > 0x206F)) & ((c < 0x3000) | (c > 0x303F)) | (c >= 97) & (c <= 122)
    c = np.where(letter, c, 32)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ two[:-1] >> 15) * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate([two, three])
    both ^= both >> 15
    both *= np.uint32(0x2C1B3C6D)
    return (both ^ both >> 13) & np.uint32(BUCKETS - 1)


def code_matrix(n: int) -> np.ndarray:
    """n codewords of +1 / -1."""
    if n <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, np.int8).T.reshape(n, -1)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(31), (-1, None)
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - m.astype(int) @ m.T) // 2 + np.eye(n, dtype=int) * bits
        if apart.min() > best[0] and (abs(m.sum(axis=0)) < n).all():
            best = (apart.min(), m)
    return best[1]


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    g = grams(text)
    total = np.zeros(weights.shape[1])
    for at in range(0, len(g), 1 << 16):
        total += weights[g[at : at + (1 << 16)]].sum(axis=0)
    return total / max(len(g), 1)


def distances(m: np.ndarray, model: dict) -> np.ndarray:
    """Weighted logistic loss of each language for the margins of texts (rows)."""
    scaled = m * model["scale"]
    loss = np.logaddexp(0, -model["codes"][None, :, :] * scaled[:, None, :])
    return (loss * model["trust"][None, :, :]).sum(axis=2)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Model from text and lang of rows outside the held-out fold."""
    rows = docs.where((crc_fold("doc_id") != 0) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) < 2:
        return {"langs": langs}
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, int(1e6 * min(1.0, fit_rows / sizes[k])) + 1)]), F.col("lang"))
    sample = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)).withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0)
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(langs), BUCKETS), np.int64)
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                seen[number[lang]] += np.bincount(grams(text), minlength=BUCKETS)
        k, b = np.nonzero(seen)
        yield pd.DataFrame({"k": k.astype(np.int32), "b": b.astype(np.int32), "n": seen[k, b]})

    counts = np.zeros((len(langs), BUCKETS))
    found = sample.where("not check").select("text", "lang").mapInPandas(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts[found["k"], found["b"]] = found["n"]
    share_of = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    codes = code_matrix(len(langs))
    weights = np.stack([np.log(share_of[bit > 0].mean(axis=0)) - np.log(share_of[bit < 0].mean(axis=0)) for bit in codes.T], axis=1).astype(np.float32)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            yield pd.DataFrame({"k": [number[x] for x in pdf["lang"]], "m": [margins(t, weights).tolist() for t in pdf["text"]], "f": [margins(t[len(t) // 2 :][:FRAGMENT], weights).tolist() for t in pdf["text"]]})

    checked = sample.where("check").select("text", "lang").mapInPandas(measure, "k int, m array<double>, f array<double>").toPandas()
    scale, trust = np.full(codes.shape[1], 20.0), np.ones(codes.shape)
    if len(checked):
        m, k = np.stack(checked["m"].to_list()), checked["k"].to_numpy()
        signed = codes[k] * m
        tries = np.logspace(0, 3, 31)
        losses = np.stack([np.logaddexp(0, -signed * a).mean(axis=0) + 1e-4 * a for a in tries])
        scale = tries[losses.argmin(axis=0)]
        for i in range(len(langs)):
            own = signed[k == i]
            trust[i] = ((own > 0).sum(axis=0) + 1) / (len(own) + 2)
    model = {"langs": langs, "codes": codes, "weights": weights, "scale": scale, "trust": trust / trust.sum(axis=1, keepdims=True), "sharp": 1.0, "lead": 0.0}
    if len(checked):
        d = distances(np.stack(checked["f"].to_list()), model)
        tries = np.logspace(-1, 3, 41)
        nll = [np.logaddexp.reduce(-a * (d - d[np.arange(len(k)), k][:, None]), axis=1).mean() for a in tries]
        model["sharp"] = float(tries[int(np.argmin(nll))])
        leads = np.sort(distances(m, model), axis=1)
        model["lead"] = float(np.quantile(leads[:, 1] - leads[:, 0], UNSURE_SHARE))
    return model


def predictions(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text)."""
    langs = model["langs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            n = len(pdf)
            pred, score, unsure = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            at = [i for i, t in enumerate(pdf["text"]) if t and _LETTER.search(t)]
            if langs and at:
                if len(langs) == 1:
                    pred[at], score[at], unsure[at] = langs[0], 1.0, False
                else:
                    d = distances(np.stack([margins(pdf["text"].iat[i], model["weights"]) for i in at]), model)
                    order = np.sort(d, axis=1)
                    pred[at] = np.array(langs, object)[d.argmin(axis=1)]
                    e = np.exp(-(d - order[:, :1]) * model["sharp"])
                    score[at] = 1 / e.sum(axis=1)
                    unsure[at] = order[:, 1] - order[:, 0] < model["lead"]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": pred, "score": score, "ambiguous": unsure})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predictions(docs, fit(docs))
    return out.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
