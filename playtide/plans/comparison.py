"""Years of customers compared over common days: orders are plays, an export runs from the first to the last order of a priority in half a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import US_PER_DAY
from playtide.functions.timefns import micros
from playtide.operators.comparison import MIN_DAYS, year_comparison
from playtide.plans.base import query

_HALF = 182


@query("review_year_comparison", f"""
with p as (select o_custkey as who, epoch_us(o_orderdate) // {US_PER_DAY} as day, o_orderpriority as priority from orders where o_custkey is not null),
x as (select distinct who, min(day) as a, max(day) as b from p group by who, priority, day // {_HALF}),
m as (select *, max(b) over (partition by who order by a, b rows between unbounded preceding and 1 preceding) as reach from x),
i as (select *, sum((reach is null or a > reach + 1)::int) over (partition by who order by a, b rows unbounded preceding) as island from m),
c as (select who, unnest(range(min(a), max(b) + 1)) as day from i group by who, island),
d as (select who, day, date '1970-01-01' + day::int as at from c),
common as (select d.who, year(d.at) as year, d.day, b.day as base from d join d b on b.who = d.who and b.day = (d.at - interval 1 year)::date - date '1970-01-01'),
runs as (select who, year, min(day) as first_day, max(day) as last_day, min(base) as base_first, max(base) as base_last from
  (select *, day - row_number() over (partition by who, year order by day) as run from common) group by who, year, run),
leaps as (select r.who, r.year, count(*) as n from runs r join p on p.who = r.who and p.day between r.base_first and r.base_last group by 1, 2),
cur as (select r.who, r.year, count(*) as n from runs r join p on p.who = r.who and p.day between r.first_day and r.last_day group by 1, 2)
select runs.who, runs.year::bigint as year, sum(last_day - first_day + 1)::bigint as days, coalesce(any_value(cur.n), 0)::bigint as current, coalesce(any_value(leaps.n), 0)::bigint as baseline,
  sum(last_day - first_day + 1) >= {MIN_DAYS} as comparable from runs left join cur using (who, year) left join leaps using (who, year) group by 1, 2""")
def review_year_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer and year against the year before, over the days that exports of both cover."""
    day = F.call_function("div", micros(F.col("o_orderdate")), F.lit(US_PER_DAY))
    plays = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey is not null").select(F.col("o_custkey").alias("who"), day.alias("day"), "o_orderpriority")
    exports = plays.groupBy("who", "o_orderpriority", F.floor(F.col("day") / _HALF)).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return year_comparison(plays, exports, "who").select("who", "year", "days", "current", "baseline", "comparable")
