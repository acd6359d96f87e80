"""Varied records of customers, from their orders: large orders, parts and suppliers that recur, months, priorities, long absences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import US_PER_DAY
from playtide.functions.timefns import micros
from playtide.operators.selection import Caps, diverse_selection
from playtide.plans.base import query
from playtide.sources.publish import scratch

_CAPS = Caps()
#: Orders whose candidates one task visits, about.
ORDERS_A_TASK = 20_000
#: Candidates: one SQL text that both engines read over ``ords`` and ``lines``; the choice is written twice.
_CANDIDATES = """
select who as owner, concat('order:', cast(what as varchar(20))) as candidate, 'market' as category, 'peak' as narrative, 'large order' as metric, priority as entity, cast(price as double) as score from {ords}
union all select who, concat('part:', cast(part as varchar(20))), 'habit', 'sustained', 'part', concat('p', cast(part as varchar(20))), cast(sum(quantity) as double) from {lines} group by who, part
union all select who, concat('supplier:', cast(supplier as varchar(20))), 'habit', 'sustained', 'supplier', concat('s', cast(supplier as varchar(20))), cast(count(*) as double) from {lines} group by who, supplier
union all select who, concat('month:', cast(month as varchar(20))), 'time', 'behavior', 'month', cast(null as varchar(20)), cast(count(*) as double) from {ords} group by who, month
union all select who, concat('priority:', priority), 'time', 'behavior', 'priority', priority, cast(count(*) as double) from {ords} group by who, priority
union all select who, concat('quantity:', cast(what as varchar(20))), 'habit', 'peak', 'quantity', cast(null as varchar(20)), cast(sum(quantity) as double) from {lines} group by who, what
union all select who, concat('gap:', cast(day as varchar(20))), 'time', 'discovery', 'gap', cast(null as varchar(20)), cast(gap as double) from
 (select who, day, day - lag(day) over (partition by who order by day) as gap from (select distinct who, day from {ords}) d) g where gap is not null"""


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    day = F.call_function("div", micros(F.col("o_orderdate")), F.lit(US_PER_DAY))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey is not null")
    ords = orders.select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("what"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), day.alias("day"), F.call_function("div", day, F.lit(30)).alias("month"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = li.join(ords, li.l_orderkey == ords.what).select("who", "what", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"))
    return {"ords": ords, "lines": lines}


@query("review_diverse_records", f"""
with recursive ords as (select *, day // 30 as month from (select o_custkey as who, o_orderkey as what, o_orderpriority as priority, o_totalprice as price, epoch_us(o_orderdate) // {US_PER_DAY} as day from orders where o_custkey is not null)),
lines as (select who, what, l_partkey as part, l_suppkey as supplier, l_quantity as quantity from lineitem join ords on l_orderkey = what),
cand as ({_CANDIDATES.format(ords="ords", lines="lines")}),
sc as (select *, case when best > 0 then round(score / best, 9) else 0 end as scaled from (select *, max(abs(score)) over (partition by owner, metric) as best from cand)),
ranked as materialized (select *, row_number() over (partition by owner order by scaled desc, category, metric, candidate) as n, row_number() over (partition by owner, narrative order by scaled desc, category, metric, candidate) = 1 as leads from sc),
visits as materialized (select owner, pass, candidate, category, metric, entity, row_number() over (partition by owner order by pass, case when pass = 1 then narrative end, n) as k from
  (select *, 1 as pass from ranked where leads union all select *, 2 from ranked union all select *, 3 from ranked)),
walk as (select distinct owner, 0::bigint as k, [{{'c': '', 'g': '', 'm': '', 'e': ''}}][1:0] as took, 0::bigint as had from ranked
  union all select w.owner, v.k,
  case when len(took) < {_CAPS.most} and (pass < 3 or case when had = 0 then len(took) else had - 1 end < {_CAPS.least})
    and len(list_filter(took, lambda t: t.g = v.category)) < case when pass = 3 then {_CAPS.relaxed} else {_CAPS.category} end and len(list_filter(took, lambda t: t.m = v.metric)) = 0
    and (v.entity is null or len(list_filter(took, lambda t: t.e = v.entity)) < {_CAPS.entity}) then list_append(took, {{'c': v.candidate, 'g': v.category, 'm': v.metric, 'e': v.entity}}) else took end,
  case when pass = 3 and had = 0 then len(took) + 1 else had end
  from walk w join visits v on v.owner = w.owner and v.k = w.k + 1),
last as (select owner, arg_max(took, k) as took from walk group by owner)
select owner, unnest(range(1, len(took) + 1))::int as place, unnest(list_transform(took, lambda t: t.c)) as candidate from last""")
def review_diverse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records chosen for every customer."""
    given = frames(spark, sf_dir)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), given["ords"].count() // ORDERS_A_TASK)
    return diverse_selection(spark.sql(_CANDIDATES, **given | {"lines": scratch(given["lines"])}), _CAPS, tasks)
