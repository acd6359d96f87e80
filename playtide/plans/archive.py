"""Cohorts, returns, search sessions, release cycles, set algebra and text search.

The save of an entity is a customer's first order, its plays are the later orders;
search sessions are the events of a user.  Day numbers count from 1970-01-01 (UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import US_PER_DAY
from playtide.functions.timefns import micros
from playtide.plans.base import query, sql_query

WINDOWS = (7, 30, 90, 365)


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("what"), F.call_function("div", micros(F.col("o_orderdate")), F.lit(US_PER_DAY)).alias("day"), "o_orderpriority")
    saves = orders.groupBy("who").agg(F.min("day").alias("saved"))
    ev = read("events").select("event_id", "user_id", micros(F.col("ts")).alias("us"), "event_type")
    return {
        "ord": orders, "sav": saves, "ev": ev, "docs": read("documents").select("doc_id", "text", "lang", "source"), "part": read("part"), "customer": read("customer"), "nation": read("nation"),
        "lineitem": read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"),
    }


PREFIX = f"""with ord as (select o_custkey as who, o_orderkey as what, epoch_us(o_orderdate) // {US_PER_DAY} as day, o_orderpriority from orders),
sav as (select who, min(day) as saved from ord group by who),
ev as (select event_id, user_id, epoch_us(ts) as us, event_type from events),
docs as (select doc_id, text, lang, source from documents)"""


def add(name: str, text: str) -> None:
    sql_query(name, text, frames, PREFIX)


add("cohort_symmetric_window", """
select s.who, count(*) filter (where o.day >= s.saved - 30 and o.day < s.saved) as before, count(*) filter (where o.day > s.saved and o.day <= s.saved + 30) as after
from {sav} s join {ord} o on o.who = s.who and o.day between s.saved - 30 and s.saved + 30 group by s.who""")
for _n in WINDOWS:
    add(f"cohort_return_within_{_n}", f"""
select count(*) as eligible, count(*) filter (where hit) as returned from (select s.who, max(case when o.day > s.saved and o.day <= s.saved + {_n} then 1 else 0 end) = 1 as hit
from {{sav}} s left join {{ord}} o on o.who = s.who where s.saved + {_n} <= (select max(day) from {{ord}}) group by s.who) x""")
add("cohort_aligned_weeks", """
select cast(floor((o.day - s.saved) / 7) as bigint) as week_offset, count(*) as plays, count(distinct o.who) as entities
from {sav} s join {ord} o on o.who = s.who and o.day >= s.saved - 28 and o.day < s.saved + 91 group by 1""")
add("cohort_vitality", """
select s.who, count(*) filter (where o.day - s.saved between 1 and 7) as d7, count(*) filter (where o.day - s.saved between 8 and 30) as d30,
  count(*) filter (where o.day - s.saved > 180) as d180, count(*) filter (where o.day - s.saved > 365) as d365 from {sav} s join {ord} o on o.who = s.who group by s.who""")
add("cohort_relationship_matrix", """
select state, count(*) as entities from (select s.who, case when s.saved > m.last_day - 90 then 'recently saved' when max(o.day) > m.last_day - 90 then 'active' else 'sleeping' end as state
from {sav} s join {ord} o on o.who = s.who cross join (select max(day) as last_day from {ord}) m group by s.who, s.saved, m.last_day) x group by state""")
add("cohort_saved_without_return", """
select c.c_custkey, c.c_mktsegment from {customer} c where not exists (select 1 from {ord} o where o.who = c.c_custkey)""")
add("returns_episodes", """
select who, count(*) filter (where gap >= 90) as episodes, max(gap) as longest, max(day) as last_day from
(select who, day, day - lag(day) over (partition by who order by day) as gap from (select distinct who, day from {ord}) d) x group by who""")
add("journey_growth", """
select saved, fresh, cast(sum(fresh) over (order by saved) as bigint) as total from (select saved, count(*) as fresh from {sav} group by saved) x""")
add("search_bursts", """
select user_id, cast(burst as bigint) as burst, count(*) as events, min(us) as start_us, max(us) as end_us from
(select user_id, us, sum(fresh) over (partition by user_id order by us, event_id rows unbounded preceding) as burst from
 (select user_id, event_id, us, case when us - lag(us) over (partition by user_id order by us, event_id) <= 3600000000 then 0 else 1 end as fresh from {ev}) f) b group by user_id, burst""")
add("search_deduplicated", "select user_id, us, event_type, min(event_id) as event_id, count(*) as copies from {ev} group by user_id, us, event_type")
add("search_volume", "select event_type, cast(floor(us / 86400000000) as bigint) as day, count(*) as n from {ev} group by 1, 2")
add("search_funnel", """
select count(*) as bursts, count(*) filter (where clicked) as followed, count(*) filter (where bought) as saved from
(select v.event_id, max(case when c.event_type = 'click' then 1 else 0 end) = 1 as clicked, max(case when c.event_type = 'purchase' then 1 else 0 end) = 1 as bought
 from {ev} v left join {ev} c on c.user_id = v.user_id and c.us > v.us and c.us <= v.us + 86400000000 where v.event_type = 'view' group by v.event_id) x""")
add("release_cycle_aligned", """
select cast(floor((o.day - r.released) / 7) as bigint) as week_offset, count(*) as plays, count(distinct l.l_partkey) as tracks from {lineitem} l join {ord} o on o.what = l.l_orderkey
join (select l2.l_suppkey, min(o2.day) as released from {lineitem} l2 join {ord} o2 on o2.what = l2.l_orderkey group by l2.l_suppkey) r on r.l_suppkey = l.l_suppkey
where o.day - r.released between 0 and 181 group by 1""")
add("release_cycle_half_life", """
select l_suppkey, min(day) filter (where 2 * so_far >= total) - min(day) as half_life from
(select l_suppkey, day, sum(n) over (partition by l_suppkey order by day) as so_far, sum(n) over (partition by l_suppkey) as total from
 (select l.l_suppkey, o.day, count(*) as n from {lineitem} l join {ord} o on o.what = l.l_orderkey group by l.l_suppkey, o.day) d) x group by l_suppkey""")
add("release_catalog_reentries", """
select l_partkey, count(*) as plays from (select l.l_partkey, o.day, r.mid from {lineitem} l join {ord} o on o.what = l.l_orderkey cross join (select cast(floor((min(day) + max(day)) / 2) as bigint) as mid from {ord}) r) x
where day between mid + 1 and mid + 168 and l_partkey not in (select l.l_partkey from {lineitem} l join {ord} o on o.what = l.l_orderkey
  cross join (select cast(floor((min(day) + max(day)) / 2) as bigint) as mid from {ord}) r where o.day between r.mid - 28 and r.mid - 1) group by l_partkey""")
add("playlist_overlap", """
select a.l_returnflag as a, b.l_returnflag as b, count(*) as shared from (select distinct l_returnflag, l_partkey from {lineitem}) a join (select distinct l_returnflag, l_partkey from {lineitem}) b on a.l_partkey = b.l_partkey group by 1, 2""")
add("library_page", "select c_custkey, c_name, c_acctbal from {customer} where lower(c_name) like '%00%' order by c_acctbal desc, c_custkey limit 25 offset 25")
add("genre_share_of_time", "select p.p_type, cast(sum(l.l_quantity) as bigint) as quantity, count(distinct l.l_partkey) as tracks from {lineitem} l join {part} p on p.p_partkey = l.l_partkey group by p.p_type")
add("region_map", "select n.n_name, count(*) as entities, count(distinct c.c_mktsegment) as segments from {customer} c join {nation} n on n.n_nationkey = c.c_nationkey group by n.n_name")
add("import_added_removed", """
select coalesce(a.what, b.what) as what, case when b.what is null then 'removed' when a.what is null then 'added' else 'unchanged' end as relation
from (select what from {ord} where day < 10000) a full outer join (select what from {ord} where day >= 9500) b on a.what = b.what""")
add("import_signed_delta", """
select who, cast(sum(n) as bigint) as plays from (select who, 1 as n from {ord} where day >= 9500 union all select who, -1 from {ord} where day < 10000) d group by who having sum(n) <> 0""")
add("import_affected_weeks", "select distinct day - (day + 3) % 7 as week from {ord} where day between 9500 and 9600")
add("search_ranked_match", """
select p_partkey, p_name, tier from (select p_partkey, p_name, case when lower(p_name) = 'red ring' then 0 when lower(p_name) like 'red ri%' then 1 when lower(p_name) like '% ring' then 2 when lower(p_name) like '%ing%' then 4 else 9 end as tier
from {part}) x where tier < 9""")
add("search_ranked_page", """
select p_type, p_partkey, n, of_kind from (select p_type, p_partkey, row_number() over (partition by p_type order by length(p_name), p_name, p_partkey) as n, count(*) over (partition by p_type) as of_kind
from {part} where lower(p_name) like '%ring%') x where n between 6 and 10""")
add("search_fuzzy", "select p_partkey, p_name, cast(levenshtein(lower(p_name), 'rad rinh') as bigint) as distance from {part} where levenshtein(lower(p_name), 'rad rinh') <= 2")
add("same_name_groups", "select p_brand, p_type, count(*) as members, min(p_partkey) as canonical from {part} group by p_brand, p_type having count(*) >= 2")
add("one_owner_per_type", "select p_type, p_partkey, p_brand from (select p_type, p_partkey, p_brand, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as n from {part}) x where n = 1")


@query("search_inverted_index", PREFIX + r""",
tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from docs)
select term, count(distinct doc_id) as documents, count(*) as occurrences from tok group by term""")
def search_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the documents with document and occurrence counts, pre-aggregated by document."""
    d = frames(spark, sf_dir)["docs"]
    tok = d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
    per = tok.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


@query("search_trigrams", PREFIX + """,
g as (select distinct p_partkey, substring(lower(p_name), i, 3) as gram from (select p_partkey, p_name, unnest(range(1, length(p_name) - 1)) as i from part))
select p_partkey, count(*) as shared from g where gram in ('red', 'ed ', 'd r', ' ri', 'rin') group by p_partkey having count(*) >= 4""")
def search_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by shared trigrams through the inverted trigram table."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_name").alias("t")).where(F.length("t") >= 3)
    grams = p.select("p_partkey", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))).alias("gram"))
    hits = grams.where(F.col("gram").isin("red", "ed ", "d r", " ri", "rin")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("shared"))
    return hits.where("shared >= 4")


@query("dataset_digest", PREFIX + " select count(*) as records, min(day) as first_day, max(day) as last_day, sum(what)::bigint as id_sum, bit_xor(what) as id_xor from ord")
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent digest of the records; partial on every task."""
    return frames(spark, sf_dir)["ord"].agg(F.count(F.lit(1)).alias("records"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("what").alias("id_sum"), F.bit_xor("what").alias("id_xor"))


@query("record_fingerprints", PREFIX + " select what, sha256(coalesce(day::varchar, '') || '|' || coalesce(who::varchar, '') || '|' || coalesce(o_orderpriority, '')) as fingerprint from ord")
def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the canonical form of each record."""
    text = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|" if c != "o_orderpriority" else "")) for c in ("day", "who", "o_orderpriority")])
    return frames(spark, sf_dir)["ord"].select("what", F.sha2(text, 256).alias("fingerprint"))
