"""Entity resolution over the catalogue: names, overlaps, containment and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.operators.identity import connected, prefix_pairs
from playtide.plans.archive import PREFIX, add
from playtide.plans.base import query

add("identity_titles", "select p_partkey, trim(regexp_replace(lower(p_name), ' (ring|box|gear|bolt)$', '')) as base from {part}")
add("identity_same_title", """
select base, count(*) as members, count(distinct p_brand) as brands, min(p_partkey) as canonical from (select p_partkey, p_brand, trim(regexp_replace(lower(p_name), ' (ring|box|gear|bolt)$', '')) as base from {part}) x group by base having count(distinct p_brand) >= 2""")
add("identity_canonical_map", """
select p_partkey, min(p_partkey) over (partition by p_brand, p_type) as canonical, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as place from {part}""")
add("identity_overlap", """
select a.p_brand as a, b.p_brand as b, count(*) as shared, round(cast(count(*) as double) / least(max(a.n), max(b.n)), 4) as ratio
from (select p_brand, p_name, count(*) over (partition by p_brand) as n from (select distinct p_brand, p_name from {part}) p) a
join (select p_brand, p_name, count(*) over (partition by p_brand) as n from (select distinct p_brand, p_name from {part}) p) b on a.p_name = b.p_name and a.p_brand < b.p_brand group by a.p_brand, b.p_brand""")
add("identity_supersets", """
select a.p_type as inner_type, b.p_type as outer_type from
(select p_type, p_name, count(*) over (partition by p_type) as n from (select distinct p_type, p_name from {part}) p) a join (select distinct p_type, p_name from {part}) b on a.p_name = b.p_name and a.p_type <> b.p_type
group by a.p_type, b.p_type, a.n having count(*) = a.n""")


@query("identity_prefixes", PREFIX + "\n" + "select a.p_partkey, b.p_partkey as longer from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and length(b.p_name) > length(a.p_name) and b.p_name like concat(a.p_name, '%')")
def identity_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name begins with that of another part of the brand."""
    return prefix_pairs(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_brand", "p_name")


add("identity_album_class", """
select p_brand, count(*) as tracks, case when count(*) = 1 then 'single' when count(*) <= 6 then 'ep' when count(*) <= 60 then 'lp' else 'compilation' end as class from {part} group by p_brand""")
add("identity_search_kind", r"""
select doc_id, case when text is null or length(text) = 0 then 'empty' when lower(text) <> upper(text) then 'letters' else 'other' end as script from {docs}""")
add("release_bonus_tracks", """
select distinct p.p_brand, p.p_name from {part} p where p.p_type <> (select min(p_type) from {part}) and not exists (select 1 from {part} q where q.p_brand = p.p_brand and q.p_name = p.p_name and q.p_type < p.p_type)""")
add("release_timeline", """
select l.l_suppkey, o.day - (o.day + 3) % 7 as week, count(*) as plays, count(distinct l.l_partkey) as tracks from {lineitem} l join {ord} o on o.what = l.l_orderkey group by l.l_suppkey, o.day - (o.day + 3) % 7""")
add("release_growth", """
select l_suppkey, before, after, round(log2((after + 1e0) / (before + 1e0)), 4) as growth from (select l.l_suppkey, count(*) filter (where o.day <= m.mid) as before, count(*) filter (where o.day > m.mid) as after
from {lineitem} l join {ord} o on o.what = l.l_orderkey cross join (select cast(floor((min(day) + max(day)) / 2e0) as bigint) as mid from {ord}) m group by l.l_suppkey) x""")
add("release_market_share", """
select l_suppkey, plays, round(100e0 * plays / sum(plays) over (), 3) as share from (select l_suppkey, count(*) as plays from {lineitem} group by l_suppkey) x""")
add("media_top_shows", "select l_suppkey, cast(sum(l_quantity) as bigint) as quantity, count(*) as plays from {lineitem} where l_quantity >= 30 group by l_suppkey order by quantity desc, l_suppkey limit 15")
add("media_split", "select l_returnflag, count(*) as plays, round(100e0 * count(*) / sum(count(*)) over (), 2) as share from {lineitem} group by l_returnflag")
add("library_overview", "select cast(floor(saved / 30e0) as bigint) as period, count(*) as saves from {sav} group by 1")
add("library_first_play_gap", """
select case when gap is null then 'never' when gap = 0 then 'same day' when gap <= 7 then 'week' when gap <= 30 then 'month' else 'later' end as bin, count(*) as entities
from (select c.c_custkey, min(o.day) - min(s.saved) as gap from {customer} c left join {sav} s on s.who = c.c_custkey left join {ord} o on o.who = c.c_custkey and o.day > s.saved group by c.c_custkey) x group by 1""")
add("search_top_queries", "select event_type, user_id, n, row_number() over (partition by event_type order by n desc, user_id) as place from (select event_type, user_id, count(*) as n from {ev} group by event_type, user_id) x")
add("returns_recent", """
select case when max_day > last_day - 30 then 'recent 30' when max_day > last_day - 90 then 'recent 90' else 'sleeping' end as state, count(*) as entities
from (select who, max(day) as max_day from {ord} group by who) a cross join (select max(day) as last_day from {ord}) m group by 1""")


@query("identity_components", """
select p_partkey, min(p_partkey) over (partition by p_brand, p_type) as component, count(*) over (partition by p_brand, p_type) > 1 as merged from part""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts tied to the next one of the same brand and type; a chain becomes one component."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    near = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    edges = p.select(F.col("p_partkey").alias("src"), F.lag("p_partkey").over(near).alias("dst")).where("dst is not null")
    found = connected(edges)
    out = p.join(found, p.p_partkey == found.node, "left")
    return out.select("p_partkey", F.coalesce("component", "p_partkey").alias("component"), F.col("component").isNotNull().alias("merged"))


@query("search_ngrams", """
with g as (select distinct doc_id, substring(w, i, 2) as gram from (select doc_id, w, unnest(range(1, length(w))) as i from (select doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]{2,}')) as w from documents)))
select gram, count(*) as documents from g group by gram""")
def search_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by bigram inside runs of characters beyond ASCII."""
    runs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]{2,}"), F.lit(0))).alias("w"))
    grams = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("gram")).distinct()
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("documents"))
