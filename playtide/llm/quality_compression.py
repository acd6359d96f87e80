"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled texts of either class.  A text is
compressed in chunks with both; the difference of the sizes, over the length of the
text, says which class explains it better, and an isotonic fit on labelled texts of a
calibration fold turns the difference into the probability of label 1.

Bound of the training sample: at most about ``FIT_ROWS`` labelled rows and
``FIT_BYTES`` bytes of each class, chosen by a hash of the id; rows longer than
``FIT_LONGEST`` bytes are not learned from.  Scoring reads every whole text.

Defined cases: a null or empty text gets the score of a difference of 0; null labels
and null ids are not learned from; a document with several labels counts with the
smallest; without labels of both classes every score is 0.5; repeated rows give
repeated rows; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import bounded, crc_fold, materialize

CHUNK, LEVEL = 2048, 3
DICTIONARY = 64 << 10
FIT_ROWS, FIT_BYTES, FIT_LONGEST = 4000, 12 << 20, 1 << 20
CUT = 0.3


def chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]


def train_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the chunks; their plain concatenation if they are too few to train on."""
    parts = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def size_difference(text: str | None, pair: list[zstandard.ZstdCompressor]) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text."""
    bad, good = pair
    parts = chunks(text)
    gap = sum(len(bad.compress(c)) - len(good.compress(c)) for c in parts)
    return gap / max(sum(map(len, parts)), 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, smoothed by one pseudo-count of each label a block."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for v, t in zip(x[order], y[order], strict=True):
        blocks.append([t, 1, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + w]
    return np.array([w / n for _, n, w in blocks]), np.array([(s + 1) / (n + 2) for s, n, _ in blocks])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from labelled rows outside the held-out fold: dictionaries (bad, good) and calibration knots."""
    rated = materialize(labels.where(F.col("quality").isNotNull() & (crc_fold("doc_id") != 0)).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q in (0, 1)"))
    held = {r["q"]: r["n"] for r in rated.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not {0, 1} <= set(held):
        return {}
    # the sample is chosen by id alone; only its texts are fetched, next to a broadcast of the ids
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = {q: int(1e6 * min(1.0, FIT_ROWS / held[q])) + 1 for q in held}
    chosen = materialize(rated.where(place < F.when(F.col("q") == 0, share[0]).otherwise(share[1])))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(bounded(chosen), "doc_id").where(F.octet_length("text") <= FIT_LONGEST)
    rows = materialize(rows)
    size = {r["q"]: r["b"] for r in rows.groupBy("q").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    part = {q: int(1e6 * min(1.0, FIT_BYTES / max(size.get(q, 0), 1))) + 1 for q in held}
    fewer = F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1_000_000)) < F.when(F.col("q") == 0, part[0]).otherwise(part[1])
    sample = rows.where(fewer).select("q", "text", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0).alias("train")).toPandas()
    if set(sample["q"]) < {0, 1}:
        return {}
    learn, rest = sample[sample["train"]], sample[~sample["train"]]
    if not len(rest) or set(learn["q"]) < {0, 1}:
        learn = rest = sample
    dictionaries = tuple(train_dictionary(list(learn["text"][learn["q"] == q])) for q in (0, 1))
    pair = compressors(dictionaries)
    x = np.array([size_difference(t, pair) for t in rest["text"]])
    y = rest["q"].to_numpy(float)
    # each class counts as often as it stands among the labelled rows
    take = np.repeat(np.arange(len(y)), _weights(y, held))
    knots, values = isotonic(x[take], y[take])
    return {"dictionaries": dictionaries, "knots": knots, "values": values}


def _weights(y: np.ndarray, held: dict) -> np.ndarray:
    """Whole-number weights that give the classes of a sample the proportions of ``held``."""
    ratio = {q: held[q] / max(1, int((y == q).sum())) for q in (0, 1)}
    low = min(ratio.values())
    return np.array([max(1, round(ratio[int(v)] / low)) for v in y])


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, gap of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = compressors(model["dictionaries"]) if model else None
        for pdf in batches:
            if pair:
                gap = np.array([size_difference(t, pair) for t in pdf["text"]])
                score = np.interp(gap, model["knots"], model["values"])
            else:
                gap, score = np.zeros(len(pdf)), np.full(len(pdf), 0.5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "gap": gap})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, gap double")


def op6_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "gap")
