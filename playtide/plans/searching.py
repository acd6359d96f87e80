"""Search over entities made of documents: every document asks three queries of the index of all.

An entity's label are the first four words of its text, its secondary name the next two,
its alias the source, its kind the language.  The queries of a document are the beginning
of its first word, its second and third word in both orders, and its fifth word without
its second letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.operators.search import FUZZY, PAGE, build_index, search
from playtide.plans.base import query
from playtide.sources.publish import scratch


def _words() -> Column:
    """The first six words; the rest of the text is not looked at."""
    begin = F.regexp_extract("text", "^(?:[^A-Za-z]*+[A-Za-z]++){0,6}+", 0)
    return F.coalesce(F.regexp_extract_all(begin, F.lit("[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    w = _words()
    return docs.select(
        F.col("doc_id").alias("entity"), F.col("lang").alias("kind"), F.array_join(F.slice(w, 1, 4), " ").alias("label"), F.array_join(F.slice(w, 5, 2), " ").alias("secondary"), F.col("source").alias("alias"), F.col("n_chars").alias("popularity")
    )


def asked(docs: DataFrame) -> DataFrame:
    """(query_id, variants): the distinct queries of all documents; the id is the first variant."""
    cut = docs.select(_words().alias("w")).where(F.size("w") >= 5)
    at = lambda i: F.lower(F.get("w", F.lit(i)))
    both = F.array(F.concat_ws(" ", at(2), at(1)), F.concat_ws(" ", at(1), at(2)))
    short = F.array(F.concat(F.substring(at(4), 1, 1), F.substring(at(4), F.lit(3), F.length(at(4)))))
    three = F.array(F.array(F.substring(at(0), 1, 5)), both, short)
    return cut.select(F.explode(three).alias("variants")).where("variants[0] <> ''").groupBy(F.col("variants")[0].alias("query_id")).agg(F.max("variants").alias("variants"))


_W = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"
_ENTITIES = f"""ent as materialized (select doc_id as entity, coalesce(lang, '') as kind, lower(array_to_string(({_W})[1:4], ' ')) as label, lower(array_to_string(({_W})[5:6], ' ')) as secondary,
  lower(trim(coalesce(source, ''))) as alias, coalesce(n_chars, 0)::bigint as popularity from documents where doc_id is not null and %s)"""
_ASKED = f"""asked as materialized (select v[1] as query_id, max(v) as v from (select unnest([[substr(w[1], 1, 5)], [w[3] || ' ' || w[2], w[2] || ' ' || w[3]], [substr(w[5], 1, 1) || substr(w[5], 3)]]) as v
  from (select string_split(lower(array_to_string({_W}, ' ')), ' ') as w from documents) where len(w) >= 5) where v[1] <> '' group by 1)"""
_TIER = """case when label = t then 0 when starts_with(label, t) then 1
  when len(list_filter(string_split(t, ' '), lambda x: not contains(' ' || label || ' ' || secondary || ' ' || alias || ' ', ' ' || x || ' '))) = 0
    and (starts_with(secondary, t) or starts_with(alias, t) or length(t) >= 3) then case when starts_with(secondary, t) or starts_with(alias, t) then 3 else 2 end
  when (contains(label, t) or contains(secondary, t) or contains(alias, t)) and (length(t) >= 3 or starts_with(secondary, t) or starts_with(alias, t)) then 4 end"""


def pages_sql(where: str = "true") -> str:
    """SQL of the first pages of all queries over the documents that ``where`` keeps."""
    return f"""
with {_ENTITIES % where}, {_ASKED},
variant as (select query_id, unnest(v) as t, unnest(range(len(v))) as nth from asked),
tiers as materialized (select query_id, entity, min(tier) as tier from (select query_id, entity, 10 * nth + {_TIER} as tier from variant, ent) where tier is not null group by all),
lost as (select query_id, query_id as t, case when length(replace(query_id, ' ', '')) <= 5 then 1 when length(replace(query_id, ' ', '')) <= 12 then 2 else 3 end as k
  from asked where query_id not in (select query_id from tiers) and length(replace(query_id, ' ', '')) >= 4),
texts as (select entity, unnest(list_concat([label, secondary, alias], string_split(label, ' '), string_split(secondary, ' '), string_split(alias, ' '))) as word from ent),
near as (select query_id, word, levenshtein(t, word) as d from lost, (select distinct word from texts where word <> '') where abs(length(t) - length(word)) <= k and levenshtein(t, word) <= k),
matched as (select * from tiers union all select query_id, entity, {FUZZY} + min(d) from near join texts using (word) group by query_id, entity),
placed as (select query_id, kind, entity, tier, row_number() over (partition by query_id, kind order by tier, case when tier < {FUZZY} then popularity else 0 end desc, label, entity) as place,
  count(*) over (partition by query_id, kind) as total from matched join ent using (entity))
select query_id, kind, place::int as place, entity, tier::int as tier, total from placed where place <= {PAGE}"""


@query("search_ranked_pages", pages_sql())
def search_ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every query of every document, by tiers or, without a match, by edit distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(build_index(entities(docs)), scratch(asked(docs)))
