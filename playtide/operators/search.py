"""Ranked search of a table of queries in an index of entities, with a fuzzy fallback.

An entity has a label, a secondary name and an alias, all in search form.  Its postings are

* ``gram``: the first one and two characters of each field, and those of one and two
  ideographs or syllable signs anywhere, for queries of fewer than three characters;
* ``token``: the whole words of all fields;
* ``joint``: the blank between two neighbours in a field with 1, 2 or 4 characters on either side;
* ``word``: every field and its words, for the fallback.

A query tries its variants in order.  Tiers of a variant (ten more for each later one):
0 the label, 1 the label's beginning, 2 all words of the query occur, 3 likewise and the
secondary name or the alias begins with it, 4 it stands inside a field.  A single word stands
inside a field if it does so inside one of its words, so it meets the distinct words, and
these their entities.  Several words occur together where the two rarest do, so they meet the
pairs of an entity's words; they stand inside a field where their rarest joint does.  None of these
ways grows with queries times entities; the fields verify the rest.  A query without any
match falls back to fields and words within an edit distance of 1, 2 or 3 by its length: k
edits spoil at most 3k pieces of three characters (of a text between two blanks on each side), so
a distinct word in reach shares one of the query's 3k + 1 rarest pieces.  Shifted by d places in a word
longer by e, it takes |d| edits before and |e - d| behind, so words are met by piece, place and length.

A match may be met in several ways, by several words or variants.  The fields tell which way is the
first, and only that one counts it.  So matches are never gathered to be told apart or written:
they are counted as they are met, and pages keep the first rows of each query and kind before the shuffle.
Postings and entities of a frequent key are split into parts of ``POSTING_ROWS`` rows, which a
lookup visits all, so that no task holds a frequent one whole.

Defined cases: null fields count as empty and match nothing; an empty or null query has no
matches; a query of fewer than four characters without its blanks has no fallback;
rows that repeat an entity are taken as one, the greatest by all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.functions.normalize import normalized
from playtide.sources.publish import scratch, side

FIELDS = ("label", "secondary", "alias")
POSTING_ROWS = 100_000
PAGE = 20
#: Ideographs, kana and hangul: short queries of these need not begin a field.
DENSE = "^[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+$"
#: Numbers of characters on either side of a joint.
JOINT = (1, 2, 4)
#: Lengths of the beginnings by which words are found in longer ones.
STEMS = range(3, 9)
#: So few keys that are split may be broadcast.
SPLIT_KEYS = 50_000
#: So few probes or entities may be broadcast; what is exploded or read from a larger table is shuffled, as files say little of its size.
PROBES = 50_000
#: Tier of the fallback, beyond every variant's.
FUZZY = 1_000


@dataclass(frozen=True)
class SearchIndex:
    """Written tables: entities, postings (kind, key, field, entity) and counts (kind, key, n)."""

    entities: DataFrame
    postings: DataFrame
    counts: DataFrame


def entity_rows(docs: DataFrame) -> DataFrame:
    """(entity, kind, label, secondary, alias, popularity) with the fields in search form, one row an entity; a null kind is empty."""
    rest = F.max(F.struct("kind", "label", "secondary", "alias", "popularity")).alias("r")
    once = docs.where("entity is not null").groupBy("entity").agg(rest)
    return once.select("entity", F.coalesce("r.kind", F.lit("")).alias("kind"), *[normalized(f"r.{f}").alias(f) for f in FIELDS], F.coalesce("r.popularity", F.lit(0)).cast("long").alias("popularity"))


def _pieces(text: Column, size: int) -> Column:
    """(key, place) of the pieces of ``size`` characters."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substring(text, i, F.lit(size)).alias("key"), i.alias("place")))


def padded(text: Column) -> Column:
    return F.concat(F.lit("  "), text, F.lit("  "))


def _tokens() -> Column:
    """The distinct words of an entity."""
    return F.array_distinct(F.filter(F.split(F.concat_ws(" ", *FIELDS), " "), lambda w: w != ""))


def _fuzzy_words() -> Column:
    """(field, word) of every field and its words."""

    def of(f: str) -> Column:
        words = F.array_distinct(F.concat(F.array(f), F.split(F.translate(f, "·", " "), " +")))
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(F.lit(f).alias("field"), w.alias("word")))

    return F.concat(*[of(f) for f in FIELDS])


def _joint(left: Column, right: Column, a: int, b: int) -> Column:
    return F.concat(F.substring(left, F.greatest(F.length(left) - a + 1, F.lit(1)), F.lit(a)), F.lit(" "), F.substring(right, 1, b))


def _joints(text: Column) -> Column:
    """Every joint of ``text`` by every two sizes that its words have room for."""
    words = F.split(text, " ")
    both = F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("x"), F.slice(words, F.lit(2), F.size(words)).alias("y"))
    some = lambda a, b: F.transform(F.filter(both, lambda p: (F.length(p["x"]) >= a) & (F.length(p["y"]) >= b)), lambda p: _joint(p["x"], p["y"], a, b))
    return F.concat(*[some(a, b) for a in JOINT for b in JOINT])


def posting_rows(entities: DataFrame) -> DataFrame:
    """(kind, key, field, entity) of every posting; only a ``word`` has a field."""
    fields = F.filter(F.array(*FIELDS), lambda t: t != "")
    begins = lambda t: F.filter(F.array(F.substring(t, 1, 1), F.substring(t, 1, 2)), lambda k: k != "")
    dense = lambda t: F.filter(F.transform(F.concat(_pieces(t, 1), _pieces(t, 2)), lambda p: p["key"]), lambda k: F.rlike(k, F.lit(DENSE)))
    keys = {"gram": F.flatten(F.transform(fields, lambda t: F.concat(begins(t), dense(t)))), "token": _tokens(), "joint": F.flatten(F.transform(fields, _joints))}
    words = entities.select("entity", F.explode(_fuzzy_words()).alias("w")).select(F.lit("word").alias("kind"), F.col("w.word").alias("key"), "w.field", "entity")
    for kind, k in keys.items():
        words = words.union(entities.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(k)).alias("key"), F.lit("").alias("field"), "entity"))
    return words


def count_rows(postings: DataFrame) -> DataFrame:
    return postings.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def build_index(docs: DataFrame) -> SearchIndex:
    """The index of ``docs`` (entity, kind, label, secondary, alias, popularity) in scratch tables."""
    entities = scratch(entity_rows(docs))
    postings = scratch(posting_rows(entities))
    return SearchIndex(entities, postings, scratch(count_rows(postings)))


def _met(probes: DataFrame, rows: DataFrame, index: SearchIndex, kind: str) -> DataFrame:
    """``probes`` (key, ...) with the ``rows`` (key, entity, ...) of their key; a frequent key by parts, in which its rows are dealt."""
    split = index.counts.where((F.col("kind") == kind) & (F.col("n") > POSTING_ROWS)).select("key", F.ceil(F.col("n") / POSTING_ROWS).cast("long").alias("parts"))
    few = split.limit(SPLIT_KEYS + 1).count()  # each stands for many postings
    if not few:
        return side(probes, PROBES).join(rows, "key")
    split = F.broadcast(split) if few <= SPLIT_KEYS else split.hint("merge")
    dealt = rows.join(split, "key", "left").withColumn("part", F.pmod(F.xxhash64("entity"), F.coalesce("parts", F.lit(1)))).drop("parts")
    visits = probes.join(split, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return visits.hint("merge").join(dealt, ["key", "part"])


def _counted(keys: DataFrame, index: SearchIndex, kind: str) -> DataFrame:
    """``keys`` (key, ...) with the number of their postings, 0 where they do not occur."""
    return keys.join(index.counts.where(F.col("kind") == kind).select("key", "n").hint("merge"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _all_words(text: Column) -> Column:
    blanks = F.concat(F.lit(" "), F.array_join(F.array(*FIELDS), " "), F.lit(" "))
    return F.forall(F.split(text, " "), lambda w: F.contains(blanks, F.concat(F.lit(" "), w, F.lit(" "))))


def tier(text: Column, variant: Column) -> Column:
    """Tier of the entity's fields for a variant; null without a match."""
    begins = lambda f: F.startswith(F.col(f), text)
    all_words = _all_words(text)
    inside = F.contains(F.col("label"), text) | F.contains(F.col("secondary"), text) | F.contains(F.col("alias"), text)
    short = (F.length(text) < 3) & ~F.rlike(text, F.lit(DENSE))
    any_begins = begins("label") | begins("secondary") | begins("alias")
    found = (
        F.when(F.col("label") == text, 0).when(begins("label"), 1).when(all_words & (begins("secondary") | begins("alias")), 3)
        .when(all_words & ~short, 2).when(inside & (~short | any_begins), 4)
    )
    return variant * 10 + found


def _word_probes(single: DataFrame, index: SearchIndex) -> DataFrame:
    """``single`` (text, ...; one word of three characters or more) with every distinct word (key) that holds it."""
    stems = lambda w: F.array_distinct(F.flatten(F.array(*[F.transform(_pieces(w, n), lambda p: p["key"]) for n in STEMS])))
    words = index.counts.where("kind = 'token'").select(F.col("key").alias("_word"), F.explode(stems(F.col("key"))).alias("_stem"))
    texts = single.withColumn("_stem", F.substring("text", 1, max(STEMS)))
    return side(texts, PROBES).join(words, "_stem").where(F.contains("_word", F.col("text"))).withColumnRenamed("_word", "key").drop("_stem")


def _pair(words: Column) -> Column:
    return F.xxhash64(F.array_min(words), F.array_max(words))


def _pair_rows(entities: DataFrame) -> DataFrame:
    """(key, entity) of every two words of an entity."""
    others = lambda w: F.transform(F.filter("_words", lambda o: o > w), lambda o: _pair(F.array(w, o)))
    keys = F.flatten(F.transform("_words", others))
    return entities.withColumn("_words", _tokens()).select(F.explode(F.array_distinct(keys)).alias("key"), "entity")


def ranked_matches(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, entity, tier, kind, label, popularity) of ``queries`` (query_id, variants: array of texts in order): every match, its best tier."""
    asked = queries.select("query_id", F.posexplode("variants").alias("variant", "text")).withColumn("text", normalized("text")).where("text <> ''")
    before = F.collect_list("text").over(Window.partitionBy("query_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, -1))
    asked = scratch(asked.withColumn("earlier", before).withColumn("words", F.array_distinct(F.split("text", " "))))
    blank, several = F.contains("text", F.lit(" ")), F.size("words") > 1
    probe = ["query_id", "variant", "text", "earlier"]
    # words, which many entities share, carry the fields to the queries; the other ways are narrow
    single = _word_probes(asked.where(~blank & (F.length("text") >= 3)), index).select("key", *probe)
    again = asked.where(blank & ~several).select(F.col("words")[0].alias("key"), *probe)
    held = index.entities.withColumn("key", F.explode(_tokens()))
    holds = F.filter(_tokens(), lambda w: F.contains(w, F.col("text")))
    by_word = _met(scratch(single.union(again)), held, index, "token").where(F.when(blank, _all_words(F.col("text"))).otherwise(F.col("key") == holds[0]))

    counted = _counted(asked.where(several).select(*probe, F.explode("words").alias("key")), index, "token")
    rarest = counted.groupBy("query_id", "variant").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("r")).where("r[0].n > 0")
    pairs = rarest.select("query_id", "variant", _pair(F.array(F.col("r")[0]["key"], F.col("r")[1]["key"])).alias("key")).join(asked.select(*probe).hint("merge"), ["query_id", "variant"])
    by_pair = side(scratch(pairs), PROBES).join(_pair_rows(index.entities), "key").select("entity", *probe, F.lit(False).alias("inside"))

    size = lambda w: F.when(F.length(w) >= 4, 4).when(F.length(w) >= 2, 2).otherwise(1)
    own = F.split("text", " ")
    ends = F.transform(own, lambda w: F.substring(w, F.length(w) - size(w) + 1, size(w)))
    starts = F.transform(own, lambda w: F.substring(w, F.lit(1), size(w)))
    joints = F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: F.concat(F.get(ends, i), F.lit(" "), F.get(starts, i + 1)))
    counted = _counted(asked.where(blank).select(*probe, F.explode(F.array_distinct(joints)).alias("key")), index, "joint")
    least = counted.groupBy("query_id", "variant", "text", "earlier").agg(F.min(F.struct("n", "key")).alias("r")).where("r.n > 0").select("r.key", *probe)
    postings = lambda kind: index.postings.where(F.col("kind") == kind).select("key", "entity")
    by_joint = _met(scratch(least), postings("joint"), index, "joint").select("entity", *probe, F.lit(True).alias("inside"))
    short = _met(asked.where(F.length("text") < 3).select(F.col("text").alias("key"), *probe), postings("gram"), index, "gram").select("entity", *probe, F.lit(False).alias("inside"))
    thin = by_pair.union(by_joint).union(short).join(side(index.entities, PROBES), "entity")
    thin = thin.where(F.when(F.col("inside"), ~_all_words(F.col("text"))).when(F.length("text") >= 3, _all_words(F.col("text"))).otherwise(True))

    columns = [*probe, "entity", "kind", "label", "secondary", "alias", "popularity"]
    met = by_word.select(columns).union(thin.select(columns))
    first = ~F.exists("earlier", lambda v: tier(v, F.lit(0)).isNotNull())
    return met.where(first).withColumn("tier", tier(F.col("text"), F.col("variant"))).where("tier is not null").select("query_id", "entity", "tier", "kind", "label", "popularity")


def allowed_edits(text: Column) -> Column:
    n = F.length(F.translate(text, " ", ""))
    return F.when(n <= 5, 1).when(n <= 12, 2).otherwise(3)


def _spots(at: Column, size: Column, k: Column) -> Column:
    """(place, size): where an untouched piece at ``at`` of a text of ``size`` may stand in words of which sizes; a shift costs edits before it, the rest of the difference edits behind it."""
    left = lambda d: k - F.abs(d)
    return F.flatten(F.transform(F.sequence(-k, k), lambda d: F.transform(F.sequence(d - left(d), d + left(d)), lambda e: F.struct((at + d).alias("place"), (size + e).alias("size")))))


def fuzzy_matches(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, entity, distance, field, kind, label, popularity) of ``queries`` (query_id, text in search form): entities with a field or word within the allowed edits."""
    able = scratch(queries.where(F.length(F.translate("text", " ", "")) >= 4).withColumn("k", allowed_edits(F.col("text"))))
    lengths = able.select(F.explode(F.sequence(F.length("text") - F.col("k"), F.length("text") + F.col("k"))).alias("_n")).distinct()
    words = index.counts.where("kind = 'word'").select(F.col("key").alias("word")).join(lengths, F.length("word") == F.col("_n"), "left_semi")
    held = scratch(words.select("word", F.explode(_pieces(padded(F.col("word")), 3)).alias("p")).select("p.key", "p.place", F.length("word").alias("size"), "word"))
    pieces = able.select("query_id", "text", "k", F.explode(_pieces(padded(F.col("text")), 3)).alias("p")).select("query_id", "text", "k", "p.key", F.col("p.place").alias("at"))
    counted = pieces.join(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "key", "at"))
    probes = counted.withColumn("_order", order).where((F.col("_order") <= 3 * F.col("k") + 1) & (F.col("n") > 0)).drop("_order", "n")
    spots = probes.withColumn("s", F.explode(_spots(F.col("at"), F.length("text"), F.col("k")))).select("query_id", "text", "k", "key", "s.place", "s.size")
    # the optimizer takes the spots for as few as the probes and would broadcast them
    near = spots.join(held.hint("merge"), ["key", "place", "size"])
    within = near.select("query_id", "text", "k", F.col("word").alias("key")).distinct().where(F.expr("levenshtein(text, key, k)") >= 0)
    rows = index.entities.withColumn("w", F.explode(_fuzzy_words())).select(F.col("w.word").alias("key"), F.col("w.field").alias("at"), *index.entities.columns)
    met = _met(scratch(within), rows, index, "word").withColumn("words", _fuzzy_words())
    # the entity's nearest field or word counts it
    reach = F.expr("filter(transform(words, w -> struct(levenshtein(text, w.word, k) as distance, if(w.field = 'secondary', 'artist', w.field) as field, w.word as word, w.field as at)), w -> w.distance >= 0)")
    best = met.withColumn("b", F.array_min(reach)).where((F.col("b.word") == F.col("key")) & (F.col("b.at") == F.col("at")))
    return best.select("query_id", "entity", "b.distance", "b.field", "kind", "label", "popularity")


def search(index: SearchIndex, queries: DataFrame, page: int = PAGE) -> DataFrame:
    """The first ``page`` entities of each query and kind: query_id, kind, place, entity, tier, total.

    ``queries`` are (query_id, variants).  Matches are ordered by tier, popularity, label and
    entity; those of the fallback, tier ``FUZZY`` and the distance, by distance, label and entity.
    """
    count = lambda rows: rows.groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    ranked = ranked_matches(index, queries)
    totals = scratch(count(ranked))
    lost = queries.select("query_id", normalized(F.get("variants", F.lit(0))).alias("text"))
    lost = lost.where("text <> ''").join(totals.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    fuzzy = fuzzy_matches(index, scratch(lost))
    near = fuzzy.select("query_id", "entity", (FUZZY + F.col("distance")).alias("tier"), "kind", "label", F.lit(0).cast("long").alias("popularity"))
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("tier", F.desc("popularity"), "label", "entity"))
    top = scratch(ranked.union(near).withColumn("place", place).where(F.col("place") <= page).drop("label", "popularity"))
    return top.join(totals.union(count(near)).hint("merge"), ["query_id", "kind"]).select("query_id", "kind", "place", "entity", "tier", "total")
