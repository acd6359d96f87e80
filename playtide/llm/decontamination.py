"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``WINDOW`` consecutive words (a shorter item is one
window).  A window is contained in a text only if all its words are, so the prefix
that must be probed is its single rarest word; rarity is the number of documents of
the corpus that hold the word, counted over all of them.  Probing yields a document
place for the window: the positional bound (the window must start and end inside the
text) and the length bound (a text shorter than the window has no place) drop
candidates, and the rest is verified word by word.

The index holds only benchmark words.  Up to ``INDEX_WORDS`` benchmark words it
travels to every task; a larger benchmark is read and probed in blocks of that size, each
a further pass over the documents that adds its hits to a written table, so neither the
driver nor a task holds more than one block.

Defined cases: a null or wordless text has no words, no hits and is clean; a null or
wordless item has no window; repeated items report each item_id; a null item_id
contaminates without being listed; repeated documents give repeated rows (rows are
matched by a row key, not by doc_id); empty tables give empty or clean results;
further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import materialize

WINDOW = 13
#: Words of benchmark text held in one index.
INDEX_WORDS = 2_000_000
#: A-Z to a-z; every byte that no word holds to a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(items: list[tuple], size: int) -> dict[tuple[bytes, ...], list]:
    """Window -> ids of the items that hold it."""
    out: dict[tuple[bytes, ...], dict] = defaultdict(dict)
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(len(w) - size + 1, min(1, len(w)))):
            out[tuple(w[i : i + size])][item_id] = None
    return {k: list(v) for k, v in out.items()}


def word_document_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each benchmark word, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = defaultdict(int)
        for pdf in batches:
            for t in pdf["text"]:
                for w in vocabulary.intersection(words_of(t)):
                    seen[w] += 1
        if seen:
            yield pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in seen], "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in rows}


def prefix_index(windows: dict, counts: dict[bytes, int]) -> dict[bytes, list]:
    """Rarest word -> [(place of the word in the window, window, item ids)]."""
    index: dict[bytes, list] = defaultdict(list)
    for win, ids in windows.items():
        rare = min(win, key=lambda w: (counts.get(w, 0), w))
        # a word that stands several times in a window is probed at its first place
        index[rare].append((win.index(rare), list(win), ids))
    return dict(index)


def find_hits(words: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set]:
    """Merged [start, end) word ranges inside occurring windows, and the ids of their items."""
    n, found, spans = len(words), set(), []
    for at, w in enumerate(words):
        for place, win, ids in index.get(w, ()):
            start = at - place
            end = start + len(win)
            if start >= 0 and end <= n and words[start:end] == win:
                spans.append((start, end))
                found.update(ids)
    merged: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, found


def _blocks(items: DataFrame, index_words: int) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of about ``index_words`` words, at least one; only one is held at a time."""
    block, held = [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        held += len(r["text"]) // 2 + 1
        if held > index_words and block:
            yield block
            block, held = [], len(r["text"]) // 2 + 1
        block.append((r["item_id"], r["text"]))
    yield block


def contamination(docs: DataFrame, items: DataFrame, carry: list[str], size: int = WINDOW, index_words: int = INDEX_WORDS) -> DataFrame:
    """row (struct of the ``carry`` columns), n_words, hit_spans ([start, end) in words) and item_ids (sorted strings).

    ``docs`` needs text, ``items`` item_id and text.  Rows pass through unshuffled.
    """
    spans, names = "array<struct<start:int,end:int>>", "array<string>"
    out = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(spans).alias("hit_spans"), F.array().cast(names).alias("item_ids"))
    schema = out.schema
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for number, block in enumerate(_blocks(items, index_words)):
        out = materialize(out) if number else out
        windows = item_windows(block, size)
        index = prefix_index(windows, word_document_counts(docs, {w for win in windows for w in win}) if windows else {})

        def probe(batches: Iterator[pa.RecordBatch], index: dict = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, spans, ids = [], [], []
                for t, s0, i0 in zip(batch["text"].to_pylist(), batch["hit_spans"].to_pylist(), batch["item_ids"].to_pylist(), strict=True):
                    words = words_of(t)
                    s, i = find_hits(words, index)
                    n.append(len(words))
                    spans.append([*({"start": a, "end": b} for a, b in s), *s0])
                    ids.append(sorted({*(str(x) for x in i if x is not None), *i0}))
                columns = [batch["row"], batch["text"], pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "hit_spans", "item_ids"])

        out = out.mapInArrow(probe, schema)
    return out.drop("text")


def with_verdict(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items and contaminated: a twentieth of the words or more are hit."""
    places = F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    return found.withColumns({"n_hit": F.size(places).cast("long"), "n_items": F.size("item_ids").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return with_verdict(contamination(docs, items, docs.columns)).where(~F.col("contaminated")).select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = with_verdict(contamination(docs, items, ["doc_id"]))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
win as (select item_id, {WINDOW} as k, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from (select item_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from b)
        union select item_id, len(w), array_to_string(w, ' ') from b where len(w) between 1 and {WINDOW - 1}),
pos as (select d.rid, x.k, i, array_to_string(w[i:i + x.k - 1], ' ') as s
        from d, (select distinct k from win) x, unnest(range(1, len(w) - x.k + 2)) u(i)),
occ as (select rid, i, win.k, item_id from pos join win using (k, s)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from occ) group by rid),
its as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from occ group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (rid) left join its using (rid)
"""
