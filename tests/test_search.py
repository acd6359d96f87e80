"""Search tiers, the fallback and split postings against a scan of all entities."""

import random

import pytest
from pyspark.sql import functions as F

from playtide.functions.normalize import normalize_text
from playtide.operators import search as se
from playtide.plans import searching

SCHEMA = "entity long, kind string, label string, secondary string, alias string, popularity long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def scan(entities, queries, page):
    out = set()
    norm = [(e, k or "", *map(normalize_text, f), p or 0) for e, k, *f, p in entities]
    for q, variants in queries:
        found = []
        for e, kind, label, second, alias, pop in norm:
            tiers = []
            for v, raw in enumerate(variants):
                t = normalize_text(raw)
                if not t:
                    continue
                fields, blanks = (label, second, alias), f" {label} {second} {alias} "
                begins, other = any(f.startswith(t) for f in fields), second.startswith(t) or alias.startswith(t)
                dense = all("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" for c in t)
                if len(t) < 3 and not dense and not begins:
                    continue
                if label == t:
                    tiers.append(10 * v)
                elif label.startswith(t):
                    tiers.append(10 * v + 1)
                elif all(f" {w} " in blanks for w in t.split(" ")):
                    tiers.append(10 * v + (3 if other else 2))
                elif any(t in f for f in fields):
                    tiers.append(10 * v + 4)
            if tiers:
                found.append((kind, min(tiers), -pop, label, e))
        t = normalize_text(variants[0]) if variants else ""
        n = len(t.replace(" ", ""))
        if not found and n >= 4:
            k = 1 if n <= 5 else 2 if n <= 12 else 3
            for e, kind, label, second, alias, _ in norm:
                words = {w for f in (label, second, alias) for w in [f, *f.replace("·", " ").split()] if w}
                d = min((distance(t, w) for w in words), default=99)
                if d <= k:
                    found.append((kind, se.FUZZY + d, 0, label, e))
        for kind in {f[0] for f in found}:
            own = sorted(f[1:] for f in found if f[0] == kind)
            out |= {(q, kind, i, r[3], r[0], len(own)) for i, r in enumerate(own[:page], 1)}
    return out


@pytest.mark.parametrize("rows", [se.POSTING_ROWS, 5])
def test_against_a_scan(spark, monkeypatch, rows):
    monkeypatch.setattr(se, "POSTING_ROWS", rows)
    rng = random.Random(4)
    name = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(n))
    entities = [(i, rng.choice(["track", "album", None]), name(rng.randint(1, 3)), rng.choice(["The Same", "the same", name(1), None]), rng.choice([None, "", name(2)]), rng.choice([None, 0, 5])) for i in range(120)]
    entities += [(200, "track", "夜に駆ける", "ヨアソビ", "Ｙｏｒｕ・ni", 3), (201, "track", "駆ける夜", None, None, 1), (202, "album", "", None, None, 0), (203, "track", "“Quoted” — naïve", "STRASSE", "straße", 9)]
    words = sorted({w for e in entities for f in e[2:5] for w in (f or "").split()})
    queries = [(f"q{i}", [w]) for i, w in enumerate(words[:60])] + [(f"x{i}", [w[:1] + w[2:]]) for i, w in enumerate(words)] + [(f"p{i}", [w[:2]]) for i, w in enumerate(words[:30])]
    queries += [("two", ["bad same the", "the same"]), ("dense", ["夜"]), ("dense2", ["ける"]), ("wide", ["yoru"]), ("quote", ['"quoted" - NAÏVE']), ("fold", ["strasse"]), ("none", ["zzzzzzzz"]), ("empty", [""]), ("blank", [" "]), ("list", []), ("long", [name(4)]), ("near", ["thesame"])]
    index = se.build_index(spark.createDataFrame(entities + entities[:3], SCHEMA))
    got = {tuple(r) for r in se.search(index, spark.createDataFrame(queries, "query_id string, variants array<string>"), 5).collect()}
    assert got == scan(entities, queries, 5)


def test_empty_index(spark):
    index = se.build_index(spark.createDataFrame([], SCHEMA))
    assert se.search(index, spark.createDataFrame([("q", ["abcd"])], "query_id string, variants array<string>")).count() == 0


@pytest.mark.parametrize(("raw", "form"), [("  Ａｂｃ　Ⅻ ", "abc xii"), ("“x” — ‘y’…", "\"x\" - 'y'..."), ("Straße", "strasse"), (None, ""), ("・ﾃｽﾄ", "·テスト")])
def test_search_form(raw, form):
    assert normalize_text(raw) == form


def test_matches_are_not_written(spark, monkeypatch):
    """Every query matches every entity, some by several words and variants; only pages and probes are written."""
    index = se.build_index(spark.createDataFrame([(i, "track", "common commons", f"name{i % 7} common", "the common", i) for i in range(200)], SCHEMA))
    written, scratch = [], se.scratch
    monkeypatch.setattr(se, "scratch", lambda df: written.append(scratch(df)) or written[-1])
    queries = [("inside", ["commo"]), ("words", ["common the", "the common"]), ("joint", ["n common"]), ("short", ["co"]), ("again", ["common", "commons"]), ("lost", ["comnon"])]
    got = se.search(index, spark.createDataFrame(queries, "query_id string, variants array<string>"), 3).collect()
    assert sorted({(r.query_id, r.total) for r in got}) == sorted((q, 200) for q, _ in queries) and len(got) == 18
    assert sum(t.count() for t in written) < 200


def test_fallback_meets_words_by_place_and_length(spark):
    """A piece in reach of k edits is met at its places and lengths only, not wherever the piece occurs."""
    spots = se._spots(F.lit(4), F.lit(9), F.lit(2))
    got = {tuple(x) for x in spark.range(1).select(spots.alias("s")).first().s}
    assert got == {(4 + d, 9 + e) for d in range(-2, 3) for e in range(-2, 3) if abs(d) + abs(e - d) <= 2}
    index = se.build_index(spark.createDataFrame([(i, "track", w, None, None, 0) for i, w in enumerate(["abxcdef", "bcdef", "xyabcdef", "abcdefghij"])], SCHEMA))
    found = se.fuzzy_matches(index, spark.createDataFrame([("q", "abcdef")], "query_id string, text string"))
    assert sorted((r.entity, r.distance) for r in found.collect()) == [(0, 1), (1, 1), (2, 2)]


def test_first_words_of_a_long_text(spark):
    """Only the beginning of a text is cut into words; the same six as of the whole text."""
    texts = ["", None, "12 ..", "one", " a-b2c\nd  é e;f g h", "x" * 5000 + " y z", "a b c d e f " + "g h " * 50_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.coalesce(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 6), F.array().cast("array<string>"))
    assert all(r.a == r.b for r in docs.select(searching._words().alias("a"), whole.alias("b")).collect())


def test_fallback_broadcasts_no_spots(spark):
    """Each probe stands for many places and lengths, which the optimizer does not see; they are not broadcast."""
    index = se.build_index(spark.createDataFrame([(1, "track", "abcdef", None, None, 0)], SCHEMA))
    joins = []
    join = type(index.entities).join

    def spy(self, other, on=None, how=None):
        joins.append((on, out := join(self, other, on, how)))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(index.entities), "join", spy)
        se.fuzzy_matches(index, spark.createDataFrame([("q", "abcdxf")], "query_id string, text string"))
    (near,) = [out for on, out in joins if isinstance(on, list) and on == ["key", "place", "size"]]
    assert "SortMergeJoin" in near._jdf.queryExecution().sparkPlan().toString()
