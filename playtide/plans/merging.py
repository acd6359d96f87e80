"""Merge plans of recordings and of compositions: parts as recordings, brands as artists.

A part's name is its title, its type the version, its size the identifier that a provider
gave it, its order lines are its plays.  Recordings merge on a shared identifier first and
on a shared title and version next; two versions of a title never share a group.
Compositions merge recording groups of one title, unless prices lie too far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.operators.merging import constrained_groups, merge_decisions
from playtide.operators.ranking import numbered
from playtide.plans.base import query
from playtide.sources.publish import scratch

#: Prices (the stand-in of durations) that conflict.
FAR_APART = 100


def _next(df: DataFrame, node: str, *by: str) -> DataFrame:
    """Each row of ``df`` with the next one by ``node`` within ``by``, as ``next``."""
    follow = F.lead(F.struct(*df.columns)).over(Window.partitionBy(*by).orderBy(node))
    return df.withColumn("next", follow).where("next is not null")


def _links(df: DataFrame, node: str, tier: int, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(F.lit(tier).alias("tier"), F.col(node).alias("src"), F.col(f"next.{node}").alias("dst"))


def recording_links(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked edges and forbidden pairs of the recordings."""
    titles = _next(part, "p_partkey", "p_brand", "p_name")
    edges = _links(_next(part, "p_partkey", "p_brand", "p_size"), "p_partkey", 1).union(_links(_next(part, "p_partkey", "p_brand", "p_name", "p_type"), "p_partkey", 2))
    ranked = numbered(scratch(edges), "rank", F.col("tier"), F.col("src"), F.col("dst"))
    return scratch(ranked), _links(titles, "p_partkey", 0, F.col("p_type") != F.col("next.p_type")).select("src", "dst")


def recording_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_retailprice")
    edges, forbidden = recording_links(part)
    groups = constrained_groups(edges, forbidden)
    grouped = part.join(groups, part.p_partkey == groups.node, "left").withColumn("group_id", F.coalesce("group", "p_partkey")).drop("node", "group")
    return scratch(grouped), edges, groups


def _sequential(nodes: str, edges: str, forbidden: str, name: str) -> str:
    """SQL that takes the edges one after another: tables ``<name>_done`` (node, grp)."""
    return f"""{name}_i as materialized (select node, row_number() over (order by node) as i from ({nodes})),
{name}_e as materialized (select row_number() over (order by tier, src, dst) as k, a.i as x, b.i as y from ({edges}) join {name}_i a on a.node = src join {name}_i b on b.node = dst),
{name}_b as materialized (select coalesce(list(distinct {{'x': a.i, 'y': b.i}}), []) as bad from ({forbidden}) join {name}_i a on a.node = src join {name}_i b on b.node = dst),
{name}_s as (select 0::bigint as k, (select list(i order by i) from {name}_i) as lab union all
  select e.k, case when len(list_filter(bad, lambda p: (lab[p.x] = lab[e.x] and lab[p.y] = lab[e.y]) or (lab[p.x] = lab[e.y] and lab[p.y] = lab[e.x]))) > 0 then lab
    else list_transform(lab, lambda g: case when g = greatest(lab[e.x], lab[e.y]) then least(lab[e.x], lab[e.y]) else g end) end
  from {name}_s s join {name}_e e on e.k = s.k + 1, {name}_b),
{name}_l as (select unnest(lab) as g, unnest(range(1, len(lab) + 1)) as i from {name}_s where k = (select max(k) from {name}_s)),
{name}_done as materialized (select n.node, r.node as grp from {name}_l l join {name}_i n on n.i = l.i join {name}_i r on r.i = l.g)"""


_EDGES = """select 1 as tier, src, dst from (select p_partkey as src, lead(p_partkey) over (partition by p_brand, p_size order by p_partkey) as dst from part) where dst is not null
  union all select 2, src, dst from (select p_partkey, lead(p_partkey) over (partition by p_brand, p_name, p_type order by p_partkey) from part) t(src, dst) where dst is not null"""
_BAD = """select src, dst from (select p_partkey as src, p_type, lead(p_partkey) over w as dst, lead(p_type) over w as other from part window w as (partition by p_brand, p_name order by p_partkey)) where p_type <> other"""
_RECORDINGS = "with recursive " + _sequential("select p_partkey as node from part", _EDGES, _BAD, "r")
_PLAYS = "plays as (select l_partkey, count(*) as plays from lineitem group by 1)"


@query("merge_recording_plan", f"""{_RECORDINGS}, {_PLAYS}
select p_partkey, grp as group_id, count(*) over (partition by grp) as members, first_value(p_partkey) over (partition by grp order by coalesce(plays, 0) desc, p_partkey) as primary_id
from part join r_done on node = p_partkey left join plays on l_partkey = p_partkey""")
def merge_recording_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its group, the group's size and its most played member."""
    grouped, _, _ = recording_groups(spark, sf_dir)
    plays = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("plays"))
    known = grouped.join(plays, grouped.p_partkey == plays.l_partkey, "left").withColumn("plays", F.coalesce("plays", F.lit(0)))
    best = F.min(F.struct((-F.col("plays")).alias("n"), F.col("p_partkey").alias("id")))
    groups = known.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), best.alias("best"))
    return grouped.join(groups, "group_id").select("p_partkey", "group_id", "members", F.col("best.id").alias("primary_id"))


@query("merge_recording_decisions", f"""{_RECORDINGS}
select tier, src, dst, a.grp = b.grp as accepted from ({_EDGES}) join r_done a on a.node = src join r_done b on b.node = dst""")
def merge_recording_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of evidence, and whether it was accepted."""
    _, edges, groups = recording_groups(spark, sf_dir)
    return merge_decisions(edges, groups).select("tier", "src", "dst", "accepted")


_UNITS = "(select grp as unit, min(p_brand) as brand, min(p_name) as name, min(p_retailprice) as price from part join r_done on node = p_partkey group by grp)"
_UNIT_EDGES = f"select 1 as tier, src, dst from (select unit as src, lead(unit) over (partition by brand, name order by unit) as dst from {_UNITS}) where dst is not null"
_UNIT_BAD = f"select src, dst from (select unit as src, price, lead(unit, 2) over w as dst, lead(price, 2) over w as other from {_UNITS} window w as (partition by brand, name order by unit)) where abs(price - other) >= {FAR_APART}"


@query("merge_composition_plan", f"""{_RECORDINGS}, {_sequential(f"select unit as node from {_UNITS}", _UNIT_EDGES, _UNIT_BAD, "c")}
select p_partkey, r_done.grp as group_id, c_done.grp as composition_id from part join r_done on r_done.node = p_partkey join c_done on c_done.node = r_done.grp""")
def merge_composition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its group and the composition that its group belongs to."""
    grouped, _, _ = recording_groups(spark, sf_dir)
    units = grouped.groupBy(F.col("group_id").alias("unit")).agg(F.min("p_brand").alias("brand"), F.min("p_name").alias("name"), F.min("p_retailprice").alias("price"))
    units = scratch(units)
    over_next = F.lead(F.struct("unit", "price"), 2).over(Window.partitionBy("brand", "name").orderBy("unit"))
    forbidden = units.withColumn("far", over_next).where(F.abs(F.col("price") - F.col("far.price")) >= FAR_APART).select(F.col("unit").alias("src"), F.col("far.unit").alias("dst"))
    edges = numbered(scratch(_links(_next(units, "unit", "brand", "name"), "unit", 1)), "rank", F.col("tier"), F.col("src"), F.col("dst"))
    groups = constrained_groups(edges, forbidden)
    return grouped.join(groups, grouped.group_id == groups.node, "left").select("p_partkey", "group_id", F.coalesce("group", "group_id").alias("composition_id"))
