"""Packing documents into fixed sequences by cutting-stock column generation.

A document (its token ids and an end id) is cut into full pieces of ``CAPACITY`` and
one rest below it, which stays whole.  Only the histogram of piece lengths, at most
``CAPACITY`` numbers, reaches the driver.  A linear program over patterns (multisets of
lengths that fit one sequence) covers the histogram with the fewest sequences.  Its
first basis comes from pricing the lengths by size: a pattern runs until one of its
lengths is used up, so the basis is triangular and feasible.  New patterns are priced by
the knapsack dynamic program over the dual prices until the bound (by the duals, or by
the total length) shows a gap below ``GAP``; if ``MAX_COLUMNS`` ends it before, a warning
states the gap.  Pattern counts are rounded down; what that leaves, fewer pieces than
basis patterns hold, is packed best-fit decreasing into patterns used once.

The pieces are then ranked within their length (salted by the square root of its count,
so neither a task's rows nor the salts of a length outgrow that), and a piece's rank names its pattern,
the pattern's instance and the offset there: no piece list is gathered anywhere.

A sequence is padded to ``CAPACITY`` unless its length is a power of two.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
once each; a null doc_id is kept; empty tables give an empty result; further columns
are ignored.  Texts whose white space is too long for the fast encoder's regular
expression are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import math
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import materialize, ranked

CAPACITY, END_ID = 1024, 0
GAP, MAX_COLUMNS = 0.0005, 3000
TOKENIZER = "byte_bpe_50k"
#: The one string that the vocabulary's own file treats as a single id.
SPECIAL = "<|endoftext|>"


def encoder(name: str = TOKENIZER):
    """text -> uint32 ids as ``tokenizers`` gives them for ``<name>.json``, without special tokens added.

    The same ranks run in ``tiktoken``, several times faster; a text that spells the
    special token, or whose white space overruns tiktoken's stack, goes through
    ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = []

    def slow(text: str) -> np.ndarray:
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return slow(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # "Max stack size exceeded for backtracking"
            return slow(text)

    return encode


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the little-endian ids) of the pieces of one document."""
    raw = np.ascontiguousarray(ids, "<u4")
    return [(s, len(raw[s : s + capacity]), zlib.crc32(raw[s : s + capacity].tobytes())) for s in range(0, len(raw), capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document, tokenised once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                out += [(doc_id, *p, len(ids)) for p in cut(ids, capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest dual value, by the unbounded knapsack dynamic program."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            v = best[c - sizes[:n]] + duals[:n]
            if v[k := int(v.argmax())] > best[c] + 1e-12:
                best[c], took[c] = v[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Basis (columns), its values and the order in which lengths leave: patterns priced by size, each run until a length of it is used up.

    A length leaves the program with the pattern that used it up, so in that order the
    matrix is triangular; large lengths are priced a little higher and go first.
    """
    n = len(sizes)
    basis, x, left = np.zeros((n, n)), np.zeros(n), demand.copy()
    live, order = np.arange(n), []
    while len(live):
        _, part = price(sizes[live], (sizes[live] / capacity) ** 1.05, capacity)
        column = np.zeros(n)
        column[live] = part
        used = live[part > 0]
        times = left[used] / column[used]
        out = int(used[times.argmin()])
        basis[:, out], x[out] = column, times.min()
        left -= column * times.min()
        live = live[live != out]
        order.append(out)
    return basis, x, order


def _inverse(basis: np.ndarray, order: list[int]) -> np.ndarray:
    """By substitution along ``order``; no BLAS, whose threads can hang in a process that has forked."""
    out = np.zeros_like(basis)
    for r in order:
        others = np.flatnonzero(basis[r])
        others = others[others != r]
        out[r, r] = 1.0
        out[r] = (out[r] - (basis[r, others][:, None] * out[others]).sum(axis=0)) / basis[r, r]
    return out


def patterns_for(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) with every piece of ``histogram`` (length -> count) in exactly one place."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n and s < capacity), int)
    full = histogram.get(capacity, 0)
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    if not len(sizes):
        return out
    demand = np.array([histogram[int(s)] for s in sizes], float)
    basis, x, order = first_basis(sizes, demand, capacity)
    inverse, bound = None, float((sizes * demand).sum()) / capacity
    for _ in range(max_columns):
        if x.sum() <= (1 + gap) * bound:
            break
        inverse = _inverse(basis, order) if inverse is None else inverse
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, column = price(sizes, duals, capacity)
        bound = max(bound, float((duals * demand).sum()) / value)
        if value <= 1 + 1e-9 or x.sum() <= (1 + gap) * bound:
            break
        held = np.flatnonzero(column)
        d = (inverse[:, held] * column[held]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x -= step * d
        x[leave] = step
        np.maximum(x, 0, out=x)
        basis[:, leave] = column
        row = inverse[leave] / d[leave]
        inverse -= np.outer(d, row)
        inverse[leave] = row
    else:
        warnings.warn(f"column generation ended after {max_columns} columns with a gap of {x.sum() / bound - 1:.4f}", stacklevel=2)
    times = np.floor(x + 1e-9).astype(int)
    left = demand.astype(int) - (basis * times).sum(axis=1).round().astype(int)
    for k in np.flatnonzero(left < 0):  # rounding of the values: give back whole patterns
        for p in np.flatnonzero(basis[k] > 0):
            while left[k] < 0 and times[p] > 0:
                times[p] -= 1
                left += basis[:, p].astype(int)
    for p in np.flatnonzero(times):
        out.append(({int(sizes[k]): int(basis[k, p]) for k in np.flatnonzero(basis[:, p])}, int(times[p])))
    return out + [(p, 1) for p in _best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, capacity)]


def _best_fit(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """The largest length opens a sequence; a subset-sum fill from what is left closes it as full as it can be."""
    out = []
    left = dict(left)
    order = sorted(left, reverse=True)
    while left:
        order = [s for s in order if s in left]
        used = Counter({order[0]: 1})
        # bit c of a mask: some of the lengths so far, each at most as often as it is left, add up to c
        room = capacity - order[0]
        masks: list[tuple[int, int]] = [(0, 1)]
        for s in order:
            for _ in range(min(left[s] - used[s], room // s)):
                masks.append((s, masks[-1][1] | masks[-1][1] << s & (1 << room + 1) - 1))
                if masks[-1][1] >> room:
                    break
            if masks[-1][1] >> room:
                break
        c = masks[-1][1].bit_length() - 1
        for (s, _), (_, before) in zip(masks[:0:-1], masks[-2::-1], strict=True):
            if not before >> c & 1:
                used[s] += 1
                c -= s
        out.append(dict(used))
        for s, k in used.items():
            left[s] -= k
            if not left[s]:
                del left[s]
    return out


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays by pattern: first rank, places a sequence, first sequence, first offset."""
    out: dict[int, list] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for s, a in sorted(pattern.items(), reverse=True):
            rows = out.setdefault(s, [[], 0])
            rows[0].append((rows[1], a, first, offset))
            rows[1] += a * times
            offset += a * s
        first += times
    return {s: tuple(np.array(rows[0], dtype=np.int64).T) for s, rows in out.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (a materialised table) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(patterns_for(histogram, capacity))
    salts = [0] + [math.isqrt(histogram.get(n, 0)) for n in range(1, capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.greatest(F.get(F.lit(salts), F.col("length").cast("int")), F.lit(1))).cast("int")
    numbered = ranked(cut_pieces, ["length"], ["doc_id", "start"], salt, "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            rank, length = pdf["rank"].to_numpy(), pdf["length"].to_numpy()
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                begin, each, first, offset = places[int(s)]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                q = rank[at] - begin[k]
                seq[at] = first[k] + q // each[k]
                off[at] = offset[k] + q % each[k] * s
            pdf = pdf.drop(columns="rank").astype({"doc_id": "Int64"})
            yield pdf.assign(sequence_id=seq, offset=off)

    return numbered.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialize(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
