"""Credits, periods and habit records: DataFrame operators, each with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY, US_PER_HOUR
from playtide.functions.timefns import micros
from playtide.operators import credits as A
from playtide.operators import habits as H
from playtide.operators import periods as P
from playtide.plans.base import query
from playtide.plans.timeline import TIMELINE_SQL, events, hours

# who is credited on the ten tracks of the listeners: raw, automatic and manual rows, some under an alias
CREDITS_SQL = """raw_credits as (select t as track_id, t % 3 as artist_id, 'primary' as role from (select unnest(range(10)) as t)
  union all select t, 3 + t % 4, 'featured' from (select unnest(range(10)) as t) where t % 2 = 0
  union all select t, 10 + t % 3, 'featured' from (select unnest(range(10)) as t) where t % 5 < 2),
aliases as (select 10 + a as artist_id, a as canonical_id from (select unnest(range(3)) as a)),
credits as (select track_id, coalesce(canonical_id, c.artist_id) as artist_id, case when bool_or(role = 'primary') then 'primary' else 'featured' end as role
  from raw_credits c left join aliases a on a.artist_id = c.artist_id group by all),
placed as (select *, row_number() over (partition by track_id order by role = 'primary' desc, artist_id) as position from credits),
joint as (select track_id from credits group by track_id having count(*) > 1)"""
PEOPLE_SQL = TIMELINE_SQL + ",\n" + CREDITS_SQL


def effective(spark: SparkSession) -> DataFrame:
    t = spark.range(10).toDF("track_id")
    x = F.col("track_id")
    rows = t.select("track_id", (x % 3).alias("artist_id"), F.lit("primary").alias("role"))
    rows = rows.union(t.where(x % 2 == 0).select("track_id", 3 + x % 4, F.lit("featured"))).union(t.where(x % 5 < 2).select("track_id", 10 + x % 3, F.lit("featured")))
    return A.effective_credits(rows, spark.range(3).select((F.col("id") + 10).alias("artist_id"), F.col("id").alias("canonical_id")))


query("credits_effective", f"with {CREDITS_SQL} select * from placed")(lambda s, d: effective(s))
query("credits_labels", f"with {CREDITS_SQL} select track_id, arg_min(artist_id, position) as primary_artist, string_agg(artist_id::varchar, ', ' order by position) as label from placed group by track_id")(
    lambda s, d: A.labels(effective(s))
)
query("credits_listener_artists", PEOPLE_SQL + " select user_id, c.artist_id, count(*) as plays, count(*) filter (where c.role = 'primary') as as_primary from e join credits c using (track_id) group by user_id, c.artist_id")(
    lambda s, d: A.fan_out(events(s, d), effective(s)).groupBy("user_id", "artist_id").agg(F.count(F.lit(1)).alias("plays"), F.sum((F.col("role") == "primary").cast("long")).alias("as_primary"))
)
query("credits_artist_shares", PEOPLE_SQL + """ select artist_id, plays, total_ms, round(plays / (select count(*) from e), 6) as play_share, round(total_ms / (select sum(ms) from s), 6) as time_share
from (select c.artist_id, count(*) as plays from e join credits c using (track_id) group by c.artist_id) join (select c.artist_id, sum(ms)::bigint as total_ms from s join credits c using (track_id) group by c.artist_id) using (artist_id)""")(
    lambda s, d: A.artist_shares(events(s, d), hours(s, d), effective(s))
)
query("collaboration_summary", PEOPLE_SQL + " select count(*) filter (where track_id in (select track_id from joint)) as plays, count(*) as all_plays from e")(
    lambda s, d: A.collaborations(events(s, d), effective(s)).agg(F.count(F.lit(1)).alias("plays")).crossJoin(events(s, d).agg(F.count(F.lit(1)).alias("all_plays")))
)
for _e in ("track_id", "album_id", "artist_id"):
    _x = "c.artist_id" if _e == "artist_id" else _e
    _j = "join credits c using (track_id)" if _e == "artist_id" else ""
    query(f"feat_lover_{_e[:-3]}", PEOPLE_SQL + f""" select *, row_number() over (order by plays desc, total_ms desc, entity_id) as place from (
select entity_id, plays, coalesce(total_ms, 0) as total_ms from (select {_x} as entity_id, count(distinct event_id) as plays from e {_j} where track_id in (select track_id from joint) group by 1) a
left join (select {_x} as entity_id, sum(ms)::bigint as total_ms from s {_j} where track_id in (select track_id from joint) group by 1) b using (entity_id)) order by place limit 50""")(
        lambda s, d, e=_e: A.collaboration_ranking(events(s, d), hours(s, d), effective(s), e)
    )

_RANGE = {
    "lifetime": ("lo", "hi"), "today": ("hi", "hi"), "this_week": ("hi - (hi + 3) % 7", "hi"), "this_year": ("hi - dayofyear(date '1970-01-01' + hi::int) + 1", "hi"),
    "last_4_weeks": ("hi - 27", "hi"), "last_6_months": ("hi - 182", "hi"), "custom": ("19730", "19736"),
}


def _period(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Plays and listened time of a period whose today is the latest day with data."""
    e, s = events(spark, sf_dir), hours(spark, sf_dir)
    # the wall clock would change the result by the day, so the latest day stands for it
    latest = e.agg(F.max("day")).first()[0]
    span = P.bounds(e, period, F.lit(latest).cast("long"), 19730, 19736)
    plays = P.within(e, span).groupBy("user_id").agg(F.count(F.lit(1)).alias("plays"))
    time = P.within(s, span).groupBy("user_id").agg(F.sum("ms").cast("long").alias("total_ms"))
    both = plays.join(time, "user_id", "full_outer").crossJoin(F.broadcast(span))
    return both.select("user_id", F.coalesce("plays", F.lit(0)).alias("plays"), F.coalesce("total_ms", F.lit(0)).alias("total_ms"), "first_day", "last_day")


for _p, (_a, _b) in _RANGE.items():
    query(f"period_{_p}", TIMELINE_SQL + f""", b as (select {_a} as a, {_b} as b from (select min(day) as lo, max(day) as hi from e)),
p as (select user_id, count(*) as plays from e, b where day between a and b group by user_id), t as (select user_id, sum(ms)::bigint as total_ms from s, b where day between a and b group by user_id)
select user_id, coalesce(plays, 0) as plays, coalesce(total_ms, 0) as total_ms, a::bigint as first_day, b::bigint as last_day from p full join t using (user_id), b""")(lambda s, d, p=_p: _period(s, d, p))  # fmt: skip


# the order lines, one play each, three hours apart within an order, reach over years
ORDER_SQL = f"""lines as (select l_orderkey * 10 + l_linenumber as event_id, l_partkey as track_id, cast(regexp_extract(p_brand, '(\\d+)$', 1) as bigint) as album_id, l_suppkey as artist_id, o_custkey as user_id,
  at_us as counted_us, cast(floor((at_us + {LOCAL_SHIFT_US}) / {US_PER_DAY}) as bigint) as day, cast(floor((at_us + {LOCAL_SHIFT_US}) / {US_PER_HOUR}) as bigint) as hour_no,
  l_returnflag = 'R' as forwarded, l_linestatus = 'O' as shuffled, 1950 + p_size as release_year
  from (select *, epoch_us(o_orderdate) + l_linenumber * {3 * US_PER_HOUR} as at_us from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)),
o as (select *, hour_no - day * 24 as hour, year(date '1970-01-01' + day::int)::bigint as year from lines)"""
ORDER = ["counted_us", "event_id"]


def order_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    at = micros(F.col("o_orderdate")) + F.col("l_linenumber") * 3 * US_PER_HOUR
    local = at + LOCAL_SHIFT_US
    day = F.floor(local / US_PER_DAY).cast("long")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_partkey").alias("track_id"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("album_id"),
        F.col("l_suppkey").alias("artist_id"), F.col("o_custkey").alias("user_id"), at.alias("counted_us"), day.alias("day"),
        (F.floor(local / US_PER_HOUR) - day * 24).cast("long").alias("hour"), F.year(F.date_from_unix_date(day.cast("int"))).cast("long").alias("year"),
        (F.col("l_returnflag") == "R").alias("forwarded"), (F.col("l_linestatus") == "O").alias("shuffled"), (F.lit(1950) + F.col("p_size")).cast("long").alias("release_year"),
    )


_O = f"with {ORDER_SQL} "
for _k in ("track_id", "album_id", "artist_id"):
    _n = _k[:-3]
    query(f"records_comeback_{_n}", _O + f"""select {_k}, gap, back_day from (select {_k}, day as back_day, day - lag(day) over (partition by {_k} order by day) as gap from (select distinct {_k}, day from o))
where gap >= 7 qualify row_number() over (partition by {_k} order by gap desc, back_day) = 1""")(lambda s, d, k=_k: H.comeback(order_plays(s, d), k))
    query(f"records_skip_storm_{_n}", _O + f"""select {_k}, count(*) as plays, sum(forwarded::int)::bigint as flagged, round(100 * sum(forwarded::int) / count(*), 1) as pct from o group by {_k} having count(*) >= 10
order by sum(forwarded::int) / count(*) desc, plays desc, flagged desc, {_k} limit 50""")(lambda s, d, k=_k: H.share_of(order_plays(s, d), k, "forwarded", 10, F.desc("plays"), F.desc("flagged"), F.asc(k)))
    if _k != "track_id":
        query(f"records_milestone_days_{_n}", _O + f"""select {_k}, n as target, day - first_day as days from (select {_k}, day, row_number() over w as n, first_value(day) over w as first_day from o window w as (partition by {_k} order by counted_us, event_id))
where n in (50, 100, 250)""")(lambda s, d, k=_k: H.fastest_milestones(order_plays(s, d), k, ORDER))
    if _k == "track_id":
        query(f"home_rediscovery", _O + f"""select {_k}, count(*) as plays, max(day) as last_day from o group by {_k} having count(*) >= 10 and max(day) < (select max(day) from o) - 90 order by plays desc, last_day, {_k} limit 20""")(
            lambda s, d, k=_k: H.rediscovery(order_plays(s, d), k)
        )
    _G = f"""x as (select user_id, list({_k} order by counted_us, event_id) as l from e group by user_id),
f as (select user_id, list_reduce(l, lambda a, x: case when list_contains(a[2:], x) then [greatest(a[1], len(a) - 1), x] else list_append(a, x) end, [0::bigint]) as r from x)
select user_id, greatest(r[1], len(r) - 1)::bigint as length from f"""
    if _k != "track_id":
        query(f"records_no_repeat_{_n}", TIMELINE_SQL + ", " + _G)(lambda s, d, k=_k: H.no_repeat_runs(events(s, d), k))

query("records_shuffle_peak", _O + """select day, count(*) as plays, sum(shuffled::int)::bigint as flagged, round(100 * sum(shuffled::int) / count(*), 1) as pct from o group by day having count(*) >= 20
order by sum(shuffled::int) / count(*) desc, flagged desc, plays desc, day desc limit 50""")(lambda s, d: H.share_of(order_plays(s, d), "day", "shuffled", 20, F.desc("flagged"), F.desc("plays"), F.desc("day")))
query("records_playback_milestones", _O + """, t as (select count(*) as n from o), r as (select event_id, track_id, day, row_number() over (order by counted_us, event_id, track_id, artist_id) as milestone from o),
g as (select unnest(case when n < 3000 then range(500, n + 1, 500) when n <= 10000 then list_distinct(list_append(list_filter([1000, 2000, 5000, 8000], lambda x: x <= n), n // 1000 * 1000))
  else list_concat([1000, 5000, 10000], range(20000, n + 1, 10000)) end) as milestone from t)
select event_id, track_id, day, milestone from r join g using (milestone)""")(lambda s, d: H.playback_milestones(order_plays(s, d).select("event_id", "track_id", "artist_id", "day", "counted_us"), [*ORDER, "track_id", "artist_id"]).drop("counted_us", "artist_id"))
query("records_new_year", _O + """, n as (select *, case when hour >= 20 then year + 1 else year end as season from o
  where strftime(date '1970-01-01' + day::int, '%m-%d') = '12-31' and hour >= 20 or strftime(date '1970-01-01' + day::int, '%m-%d') = '01-01' and hour <= 4)
select season, count(*) as plays, (select track_id from n m where m.season = n.season group by track_id order by count(*) desc, track_id limit 1) as top_track,
  (select artist_id from n m where m.season = n.season group by artist_id order by count(*) desc, artist_id limit 1) as top_artist from n group by season having count(*) >= 3""")(
    lambda s, d: H.new_year(order_plays(s, d))
)


def _releases(plays: DataFrame) -> DataFrame:
    return plays.select("track_id", "release_year").distinct()


query("wrapped_listening_age", _O + """, c as (select user_id, year, track_id, any_value(release_year) as release_year, count(*) as n from o group by user_id, year, track_id
  qualify row_number() over (partition by user_id, year order by count(*) desc, track_id) <= 50)
select user_id, year, round_even(avg(release_year), 0)::bigint as avg_release_year, greatest(0, year - round_even(avg(release_year), 0)::bigint) as age from c group by user_id, year""")(
    lambda s, d: H.listening_age(order_plays(s, d).drop("release_year"), _releases(order_plays(s, d)), ["user_id"])
)
query("wrapped_trend_chaser", _O + "select user_id, year, least(100.0::double, round(200 * count(*) filter (where release_year = year) / count(*), 4)) as score from o group by user_id, year")(
    lambda s, d: H.trend_chaser(order_plays(s, d).drop("release_year"), _releases(order_plays(s, d)), ["user_id"])
)
#: Of the two highest dimensions, else of the highest.
PAIRS = {("explorer", "globetrotter"): "traveller", ("globetrotter", "explorer"): "traveller", ("loyalist", "collector"): "connoisseur", ("collector", "loyalist"): "connoisseur", ("binger", "night_owl"): "engine"}
FALLBACK = {"explorer": "explorer", "night_owl": "night owl", "loyalist": "loyalist", "binger": "binger", "collector": "collector"}
DIMS = ["explorer", "night_owl", "loyalist", "binger", "collector"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.round(100 * F.count_distinct("track_id") / n, 1).alias("explorer"), F.round(100 * F.sum((F.col("hour") < 6).cast("long")) / n, 1).alias("night_owl"),
        F.round(100 * F.sum((F.col("artist_id") == 0).cast("long")) / n, 1).alias("loyalist"), F.round(100 * (1 - F.count_distinct("day") / n), 1).alias("binger"),
        F.round(100 * F.sum((F.col("album_id") == 1).cast("long")) / n, 1).alias("collector"),
    )


_CASE = " ".join(f"when p[1] = '{a}' and p[2] = '{b}' then '{v}'" for (a, b), v in PAIRS.items()) + " " + " ".join(f"when p[1] = '{a}' then '{v}'" for a, v in FALLBACK.items())
query("wrapped_personality_label", TIMELINE_SQL + f""", sc as (select user_id, round(100 * count(distinct track_id) / count(*), 1) as explorer, round(100 * count(*) filter (where hour < 6) / count(*), 1) as night_owl,
  round(100 * count(*) filter (where artist_id = 0) / count(*), 1) as loyalist, round(100 * (1 - count(distinct day) / count(*)), 1) as binger, round(100 * count(*) filter (where album_id = 1) / count(*), 1) as collector from e group by user_id),
u as (select user_id, d, i, case d {" ".join(f"when '{d}' then {d}" for d in DIMS)} end as v from sc, (values {", ".join(f"('{d}', {i})" for i, d in enumerate(DIMS))}) t(d, i)),
g as (select user_id, list(d order by v desc, i) as p from u group by user_id)
select sc.*, p[1] as "primary", case {_CASE} else 'traveller' end as label from sc join g using (user_id)""")(lambda s, d: H.resolve_personality(_scores(s, d), DIMS, PAIRS, FALLBACK, "traveller"))
