"""Spelling variant groups by full neighbourhood generation.

The vocabulary holds the words of a corpus that are long and frequent enough.  Two of
its words are near if one inserted, deleted or replaced character turns one into the
other.  Every word generates its whole neighbourhood, each member once: all deletions,
all replacements and all insertions over the observed alphabet.  A hash join with the
vocabulary keeps the members that are words; nothing is compared or measured.  A word's
form is its most frequent near word, if that is frequent enough; following forms gives
the root of its group.

* Words are counted inside a batch of documents first, then pre-aggregated and shuffled.
* A neighbourhood is generated as hashes: a member's hash follows from prefix sums of its
  word, so it costs a few operations and no string.  Members whose two places in a bitmap
  of the vocabulary are empty are no words; of the others the strings are built and joined
  with the vocabulary.  The bitmap has ``FILTER_BITS`` bits whatever the vocabulary; a
  vocabulary too large for it lets more strings through to the join, none is lost.
* Members are generated in chunks of ``CHUNK``, and nothing is gathered for a word.  A
  vocabulary word is met by at most its own neighbourhood, so no join key is hot.
* A member that arises at several places (inserting or deleting inside a run of one
  letter) is kept at one of them, so no distinct is needed.

Defined cases: null, empty and wordless texts give no words; a null id counts as an
empty one; rows that repeat an id are counted as often; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import bounded, materialize
from playtide.llm.importance_resampling import CRC_TABLE, LOWER, UPPER, crc_sql
from playtide.llm.shingles import mix

LETTERS = "a-z\u00c0-\u00ff"
MIN_LENGTH, MIN_COUNT, FACTOR, NOISE = 5, 3, 2, 97
FILTER_BITS = 1 << 26
#: Members hashed at once, and distinct words counted before a task hands them on.
CHUNK, HELD_WORDS = 1 << 20, 200_000
#: Eight-byte words of the bitmap that come to the driver as one row.
PAGE = 1 << 10
#: Words whose neighbourhoods one task generates.
TASK_WORDS = 5_000
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def misspelt(doc_id: str, run: str, one_in: int = NOISE) -> str:
    """The run, or, for one in ``one_in`` pairs of document and run, the run without one letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, id_col: str, alter: Callable[[str, str], str] | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n), written: runs of letters, A-Z lower-cased, that are long and frequent enough.

    ``alter`` may shorten a run, given its document's id; it is asked once a document and run.
    """
    pattern = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    found = Counter(pattern.findall(text.encode().lower().decode()))
                    for run, n in found.items():
                        total[alter(doc or "", run) if alter else run] += n
                if len(total) > HELD_WORDS:
                    yield held()
                    total.clear()
        yield held()

    counted = docs.select(F.col(id_col).cast("string").alias("id"), "text").mapInArrow(count, "word string, n long")
    return materialize(counted.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(_U) + _U(0x1F83D9ABFB41BD6B))


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _same_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the words of each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        yield which, np.frombuffer("".join(words[k] for k in which).encode("utf-32-le"), np.uint32).reshape(-1, n)


def _prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, powers and prefix sums (from 0) of words of one length."""
    value, power = _values(codes), _powers(codes.shape[1] + 1, _STEP)
    sums = np.zeros((len(codes), codes.shape[1] + 1), _U)
    np.cumsum(value * power[:-1], axis=1, out=sums[:, 1:])
    return value, power, sums


def _places(hashes: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the bitmap for the hash of a word and its length."""
    spread = mix(hashes + _U(length))
    return spread & _U(bits - 1), (spread >> _U(32)) & _U(bits - 1)


def bitmap(vocab: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap (bytes) with two bits of each word: set in the tasks, united by eight bytes, sent by pages, of a fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            for _, codes in _same_length(words) if words else ():
                at = np.concatenate(_places(_prefix_sums(codes)[2][:, -1], codes.shape[1], bits))
                yield pa.RecordBatch.from_pydict({"slot": (at >> _U(6)).astype(np.int64), "bit": (_U(1) << (at & _U(63))).view(np.int64)})

    def page(key: tuple, slots: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(PAGE, np.int64)
        words[slots["slot"].to_numpy() % PAGE] = slots["bits"].to_numpy()
        return pd.DataFrame({"page": [key[0]], "words": [words.tobytes()]})

    marked = vocab.select("word").mapInArrow(mark, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    pages = marked.groupBy(F.floor(F.col("slot") / PAGE).alias("page")).applyInPandas(page, "page long, words binary")
    out = np.zeros((max(1, bits // 64 // PAGE), min(PAGE, bits // 64)), np.int64)
    for r in pages.collect():  # FILTER_BITS bits together
        out[r.page] = np.frombuffer(r.words, np.int64)[: out.shape[1]]
    return out.reshape(-1).view(np.uint8)


def observed_letters(vocab: DataFrame) -> np.ndarray:
    """Code points of the characters of the vocabulary (an alphabet: small)."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch["word"].to_pylist()).encode("utf-32-le"), np.uint32)
            yield pa.RecordBatch.from_pydict({"c": np.unique(codes).astype(np.int64)})

    return np.sort(vocab.select("word").mapInArrow(letters, "c long").distinct().toPandas()["c"].to_numpy(np.int64)).astype(np.uint32)


def neighbourhood(codes: np.ndarray, letters: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, place, end, letter) of the members of each row's neighbourhood that ``known`` may hold.

    ``codes`` are words of one length; the member is the row's word with the characters from
    place to end replaced by the letter (-1: none).  Rows are taken in chunks.
    """
    bits = len(known) * 8
    length, inverse, value_of = codes.shape[1], _U(_BACK), _values(letters)

    def held(at: np.ndarray) -> np.ndarray:
        return (known[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 != 0

    def probe(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        spread = mix(hashes.ravel() + _U(size))
        hit = np.flatnonzero(held(spread & _U(bits - 1)))
        hit = hit[held((spread[hit] >> _U(32)) & _U(bits - 1))]
        return list(np.unravel_index(hit, hashes.shape))

    value, power, sums = _prefix_sums(codes)
    places = max(1, CHUNK // max(1, length * len(letters)))
    for first in range(0, len(codes), places):
        c, v, s = codes[first : first + places], value[first : first + places], sums[first : first + places]
        whole = s[:, -1:]
        row, at = probe(s[:, :-1] + (whole - s[:, 1:]) * inverse, length - 1)
        last = np.ones(len(row), bool)
        inner = at < length - 1
        last[inner] = c[row[inner], at[inner]] != c[row[inner], at[inner] + 1]
        yield from zip((row[last] + first).tolist(), at[last].tolist(), (at[last] + 1).tolist(), [-1] * int(last.sum()), strict=True)
        span = max(1, CHUNK // max(1, len(letters) * len(c)))  # a very long word is taken in parts
        for lo in range(0, length + 1, span):
            own = slice(lo, min(lo + span, length))
            row, at, a = probe((whole - v[:, own] * power[own])[:, :, None] + (value_of[None, :] * power[own, None])[None], length)
            other = c[row, at + lo] != letters[a]
            yield from zip((row[other] + first).tolist(), (at[other] + lo).tolist(), (at[other] + lo + 1).tolist(), letters[a[other]].tolist(), strict=True)
            own = slice(lo, min(lo + span, length + 1))
            row, at, a = probe((s[:, own] + (whole - s[:, own]) * _U(_STEP))[:, :, None] + (value_of[None, :] * power[own, None])[None], length + 1)
            at = at + lo
            fresh, inner = np.ones(len(row), bool), at < length
            fresh[inner] = c[row[inner], at[inner]] != letters[a[inner]]
            yield from zip((row[fresh] + first).tolist(), at[fresh].tolist(), at[fresh].tolist(), letters[a[fresh]].tolist(), strict=True)


def near_words(vocab: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of near words of ``vocab`` (word, n), a written table."""
    context = vocab.sparkSession.sparkContext
    known, letters = context.broadcast(bitmap(vocab, bits)), context.broadcast(observed_letters(vocab))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch["word"].to_pylist(), batch["n"].to_pylist()
            for which, codes in _same_length(words) if words else ():
                out: tuple[list, list, list] = ([], [], [])
                size = 0
                for k, at, end, letter in neighbourhood(codes, letters.value, known.value):
                    w = words[which[k]]
                    out[0].append(w)
                    out[1].append(n[which[k]])
                    out[2].append(w[:at] + (chr(letter) if letter >= 0 else "") + w[end:])
                    size += len(w) + 20
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["word", "n", "near"])
                        out, size = ([], [], []), 0
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["word", "n", "near"])

    tasks = max(1, vocab.count() // TASK_WORDS)
    return vocab.repartition(tasks).mapInArrow(emit, "word string, n long, near string").join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, doubling the steps a round.

    A form is at least twice as frequent as its word, so chains have at most 63 steps.
    """
    cur = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        ahead = cur.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        cur = materialize(cur.join(bounded(ahead), F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if not cur.where("moved").limit(1).count():
            return cur.drop("moved")
        cur = cur.drop("moved")
    raise RuntimeError("forms do not end")


def variant_groups(vocab: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab`` (word, n), a written table."""
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near")))
    near = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.neg") >= factor * F.col("n")
    found = materialize(
        vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.neg")).cast("long").alias("form_n"))
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variant_groups(vocabulary(docs, "doc_id", misspelt))


ORACLE_SQL = f"""
with recursive {CRC_TABLE},
r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents where text is not null),
pairs as (select id, run, count(*) as c from r where length(run) >= {MIN_LENGTH} group by all),
hashed as (select id, run, c, {crc_sql("id || ':' || run")} as h from pairs, crc_steps),
altered as (select c, case when h % {NOISE} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
vocab as materialized (select word, sum(c)::bigint as n from altered where length(word) >= {MIN_LENGTH} group by word having sum(c) >= {MIN_COUNT}),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from vocab),
cuts as materialized (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as short from places),
holes as materialized (select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from places),
near as materialized (select v.word, v.n, c.word as near, c.n as near_n from vocab v join cuts c on v.word = c.short
  union all select c.word, c.n, v.word, v.n from vocab v join cuts c on v.word = c.short
  union all select a.word, a.n, b.word, b.n from holes a join holes b using (i, head, tail) where a.word <> b.word),
best as (select word, count(*)::bigint as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
formed as materialized (select vocab.word, n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= {FACTOR} * n then near end as form, case when near_n >= {FACTOR} * n then near_n end::bigint as form_n
  from vocab left join best using (word)),
follow as (select word, word as root from formed where form is null union all select f.word, follow.root from formed f join follow on f.form = follow.word)
select word, form, root, n, n_near, form_n from formed join follow using (word)
"""
