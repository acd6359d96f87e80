"""Places of pattern matches as DataFrame expressions (code points, end exclusive).

Folds over the matches of a text run in blocks of ``BLOCK``, then over the blocks, and
pieces of a text are cut from blocks of it, so that a text with very many matches costs
little more than their number and its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(xs: Column) -> Column:
    """The elements of ``xs`` (a bound value) in arrays of ``BLOCK``."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(xs, i, F.lit(BLOCK)))


def before_each(values: Column, first: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints ``values``, ``first`` combined with all before it; ``combine`` is associative and ``first`` neutral."""
    begin = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))
    joint = F.struct(F.lit(first).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def join(acc: Column, part: Column) -> Column:
        return F.struct(combine(acc["at"], part["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(part["out"], lambda x: combine(acc["at"], x)))).alias("out"))

    def fold(xs: Column) -> Column:
        return F.aggregate(F.transform(blocks(xs), lambda b: F.aggregate(b, begin, step)), joint, join, lambda acc: F.flatten(acc["out"]))

    return bound(values, fold)


def find_spans(text: Column, pattern: str, kind: str, rank: int, trigger: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern``; those that fail ``keep`` are dropped, without a retry.

    The pieces between the matches (``split``) and the matches themselves alternate,
    so their running lengths give the places.  Texts without ``trigger`` are not searched.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())

    def span(z: Column) -> Column:
        begin = (z["at"] + F.length(z["pair"]["gap"])).cast("int")
        end = (begin + F.length(z["pair"]["hit"])).cast("int")
        return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), z["pair"]["hit"].alias("match"))

    def placed(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
        return F.transform(F.arrays_zip(ps.alias("pair"), before_each(lengths, 0, lambda a, b: a + b).alias("at")), span)

    found = bound(pairs, placed)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.when(trigger, found).otherwise(F.array().cast(SPAN))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def distinct_spans(spans: Column) -> Column:
    """Each span once, in order."""
    return bound(F.sort_array(spans), lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))


def free_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start: from the furthest end before and the nearest start behind."""
    none = F.lit(None).cast(SPAN)[0]
    far = 1 << 30

    def event(s: Column, asks: bool) -> Column:
        return F.struct(s["start"].alias("at"), F.lit(int(asks)).alias("asks"), s["end"].alias("end"), (s if asks else none).alias("s"))

    events = F.sort_array(F.concat(F.transform(others, lambda s: event(s, False)), F.transform(spans, lambda s: event(s, True))))

    def free(es: Column) -> Column:
        reach = before_each(F.transform(es, lambda e: F.when(e["asks"] == 1, 0).otherwise(e["end"])), 0, F.greatest)
        starts = F.reverse(F.transform(es, lambda e: F.when(e["asks"] == 1, far).otherwise(e["at"])))
        behind = F.reverse(before_each(starts, far, F.least))
        kept = F.filter(F.arrays_zip(es.alias("e"), reach.alias("reach"), behind.alias("behind")), lambda z: (z["e"]["asks"] == 1) & (z["reach"] <= z["e"]["at"]) & (z["behind"] >= z["e"]["end"]))
        return F.transform(kept, lambda z: z["e"]["s"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(events, free))


def best_apart(scored: Column) -> Column:
    """Spans of ``scored`` (p, s), the best first, that overlap no span taken before; decided within each run of touching spans."""
    by_place = F.sort_array(F.transform(scored, lambda w: F.struct(w["s"].alias("s"), w["p"].alias("p"))))

    def greedy(run: Column) -> Column:
        first = F.array_sort(run, lambda v, w: F.when(v["p"] > w["p"], -1).when(v["p"] < w["p"], 1).when(v["s"] < w["s"], -1).when(v["s"] > w["s"], 1).otherwise(0))
        return F.aggregate(first, F.array().cast(SPAN), lambda kept, w: F.when(F.exists(kept, lambda v: overlaps(v, w["s"])), kept).otherwise(F.concat(kept, F.array(w["s"]))))

    def runs(ws: Column) -> Column:
        reach = before_each(F.transform(ws, lambda w: w["s"]["end"]), 0, F.greatest)
        heads = F.transform(F.filter(F.transform(F.arrays_zip(ws.alias("w"), reach.alias("at")), lambda z, i: F.when(z["w"]["s"]["start"] >= z["at"], i + 1)), lambda i: i.isNotNull()), lambda i: i)

        def cut(hs: Column) -> Column:
            return F.transform(hs, lambda h, k: F.slice(ws, h, F.coalesce(F.get(hs, k + 1), F.size(ws) + 1) - h))

        return F.flatten(F.transform(bound(heads, cut), lambda run: F.when(F.size(run) == 1, F.transform(run, lambda w: w["s"])).otherwise(greedy(run))))

    return F.when(F.size(scored) == 0, F.array().cast(SPAN)).otherwise(bound(by_place, runs)).cast(SPAN)


def named(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of spans in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``; ``spans`` in order of start."""

    def block(b: Column) -> Column:
        # the stretch of the text up to the block's last span is cut out once
        base, last = b[0]["at"], F.element_at(b, -1)["s"]["start"]
        cut = F.substring(text, base + 1, last - base)
        return bound(cut, lambda room: F.array_join(F.transform(b, lambda z: F.concat(F.substring(room, z["at"] - base + 1, z["s"]["start"] - z["at"]), F.lit(mark))), ""))

    def clean(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: s["end"])
        fresh = F.filter(F.arrays_zip(ss.alias("s"), before_each(ends, 0, F.greatest).alias("at")), lambda z: z["s"]["start"] >= z["at"])
        head = F.array_join(bound(fresh, lambda zs: F.transform(blocks(zs), block)), "")
        return F.concat(head, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, clean))
