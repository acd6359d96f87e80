"""Weekly chart queries over order lines: tracks are parts, albums brands, artists suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY, ChartConfig
from playtide.operators import charts as C
from playtide.plans.base import query, sql_query
from playtide.sources.publish import scratch
from playtide.sources.plays import CHART_PLAYS_SQL, chart_plays

SIZE = {"track": 30, "album": 10, "artist": 10}
KINDS = list(SIZE)


def weekly(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.weekly_rankings(C.weekly_totals(chart_plays(spark, sf_dir), f"{kind}_id", ChartConfig()), SIZE[kind])

    return run


def frames(spark: SparkSession, sf_dir: str, plays: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames by name; ``plays`` are read by each one that a query uses, so those of several are written first."""
    plays = chart_plays(spark, sf_dir) if plays is None else plays
    day = F.call_function("div", F.col("end_us") + LOCAL_SHIFT_US, F.lit(US_PER_DAY))
    dated = plays.withColumn("day", day).withColumn("week", F.col("day") - F.pmod(F.col("day") + 3, F.lit(7)))
    out = {f"w_{k}": C.weekly_rankings(C.weekly_totals(plays, f"{k}_id", ChartConfig()), SIZE[k]) for k in KINDS}
    out |= {f"sum_{k}": C.summary(out[f"w_{k}"]) for k in KINDS}
    return out | {"cp": dated}


def written_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``frames`` over plays that are joined once."""
    return frames(spark, sf_dir, scratch(chart_plays(spark, sf_dir)))


def _weekly_sql(k: str) -> str:
    return f"""w_{k} as (select * from (select entity, week, plays, ms, row_number() over (partition by week order by plays desc, ms desc, entity) as rank from
  (select {k}_id as entity, week, sum(plays)::bigint as plays, sum(ms)::bigint as ms from cp group by all having sum(plays) > 0)) where rank <= {SIZE[k]}),
sum_{k} as (select entity, min(peak) as peak, count(distinct week) as weeks, count(*) filter (where rank = peak) as weeks_at_peak, count(*) filter (where rank = 1) as no1_weeks, min(week) as first_week,
  max(week) as last_week, min(week) filter (where rank = peak) as first_peak_week, sum(plays)::bigint as chart_plays, min(peak) = 1 and min(week) = min(week) filter (where rank = peak) as debut_no1
  from (select *, min(rank) over (partition by entity) as peak from w_{k}) group by entity)"""


CHART_SQL = f"""with {CHART_PLAYS_SQL},
cp as (select *, day - (day + 3) % 7 as week from (select *, (end_us + {LOCAL_SHIFT_US}) // {US_PER_DAY} as day from chart_plays)),
""" + ",\n".join(_weekly_sql(k) for k in KINDS)


def add(name: str, text: str) -> None:
    sql_query(name, text, frames, CHART_SQL)


def _score_sql(k: str, by: str = "") -> str:
    """CTE ``scored``: the weekly score of each row; ``by`` partitions it (a column of the frame)."""
    part = f"{by}, " if by else ""
    src = f"(select *, year(date '1970-01-01' + week::int)::bigint as year from w_{k})"
    return f""",
wt as (select {part}week, sum(plays) as week_total, median(plays) as week_median, max(plays) filter (where rank = 2) as second from {src} group by {part}week),
bl as (select {part}median(week_total) as baseline from wt {"group by " + by if by else ""}),
scored as (select r.*, greatest(1.0::double, round_even(200 * pow(0.87::double, rank - 1), 0)) * least(greatest(sqrt(week_total / baseline), 0.7), 1.5)
  * case when rank = 1 then case when second is null then 2.0::double else 1 + least(greatest(0.5 * log2(plays / second), 0.0), 1.0) end
         else 1 + least(greatest(0.4 * log2(plays / week_median), 0.0), 0.8) end as score
  from {src} r join wt on r.week = wt.week {"and r." + by + " = wt." + by if by else ""} {"join bl on bl." + by + " = r." + by if by else "cross join bl"}),
pk as (select *, min(rank) over (partition by {part}entity) as pk from scored),
ag as (select {part}entity, sum(score) as raw, count(distinct week) as weeks, min(rank) as peak, count(*) filter (where rank = pk) as weeks_at_peak, count(*) filter (where rank = 1) as no1_weeks,
  arg_min(rank, week) as first_rank from pk group by {part}entity),
pw as (select {part}entity, round(raw, 4) as raw, weeks, peak, weeks_at_peak, no1_weeks,
  round_even(round(raw + 45 * sqrt(weeks) + case peak when 1 then 200 when 2 then 100 when 3 then 50 else 0 end + {"case when first_rank = 1 then 50 else 0 end" if k == "track" else "40 * no1_weeks"}, 6), 0)::bigint as power from ag),
scores as (select *, row_number() over ({"partition by " + by if by else ""} order by power desc, entity) as power_rank from pw)"""


for _k in KINDS:
    _w = weekly(_k)
    query(f"chart_weekly_{_k}", CHART_SQL + f" select entity, week, rank, plays, ms from w_{_k}")(lambda s, d, w=_w: w(s, d).select("entity", "week", "rank", "plays", "ms"))
    query(
        f"chart_running_{_k}",
        CHART_SQL + f""", a as (select entity, week, rank, min(rank) over (partition by entity order by week rows unbounded preceding) as running_peak, row_number() over (partition by entity order by week) as running_wks from w_{_k})
select *, sum(case when rank = running_peak then 1 else 0 end) over (partition by entity, running_peak order by week rows unbounded preceding)::bigint as running_peak_wks from a""",
    )(lambda s, d, w=_w: C.running_metrics(w(s, d)).select("entity", "week", "rank", "running_peak", "running_wks", "running_peak_wks"))
    query(f"chart_power_{_k}", CHART_SQL + _score_sql(_k) + " select entity, raw, weeks, peak, weeks_at_peak, no1_weeks, power, power_rank from scores")(
        lambda s, d, w=_w, k=_k: C.power_scores(w(s, d), k).select("entity", "raw", "weeks", "peak", "weeks_at_peak", "no1_weeks", "power", "power_rank")
    )
    query(f"chart_year_end_{_k}", CHART_SQL + _score_sql(_k, "year") + " select year, entity, power, power_rank, weeks, peak, no1_weeks from scores where power_rank <= 20")(
        lambda s, d, w=_w, k=_k: C.power_scores(w(s, d).withColumn("year", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("week").cast("int"))).cast("long")), k, "year")
        .where("power_rank <= 20").select("year", "entity", "power", "power_rank", "weeks", "peak", "no1_weeks")
    )
    query(f"chart_summary_{_k}", CHART_SQL + f" select * from sum_{_k}")(lambda s, d, w=_w: C.summary(w(s, d)))
    query(
        f"chart_change_{_k}",
        CHART_SQL + f""", l as (select *, lag(rank) over o - rank as step, week - lag(week) over o as gap from w_{_k} window o as (partition by entity order by week))
select entity, week, rank, case when gap is null then 'NEW' when gap > {C.ADJACENT_DAYS} then 'RE' when step > 0 then 'up ' || step when step < 0 then 'down ' || -step else 'same' end as change from l""",
    )(lambda s, d, w=_w: C.change_column(w(s, d)).select("entity", "week", "rank", "change"))
    _islands = """, f as (select *, case when coalesce(week - lag(week) over o > 8, true) {extra} then 1 else 0 end as fresh from w_{k} window o as (partition by entity order by week)),
i as (select *, sum(fresh) over (partition by entity order by week rows unbounded preceding) as island from f),
g as (select entity, island, count(*) as length, min(week) as start_week, max(week) as end_week{first} from i group by entity, island)
select entity, length, start_week, end_week{cols} from (select *, row_number() over (partition by entity order by length desc, start_week) as n from g) where n = 1"""
    query(f"record_longest_streak_{_k}", CHART_SQL + _islands.format(k=_k, extra="", first="", cols=""))(lambda s, d, w=_w: C.streaks(w(s, d)))
    query(f"record_same_rank_{_k}", CHART_SQL + _islands.format(k=_k, extra="or rank is distinct from lag(rank) over o", first=", min(rank) as rank", cols=", rank"))(lambda s, d, w=_w: C.streaks(w(s, d), "rank"))

for _k in KINDS:
    add(f"record_return_to_no1_{_k}", f"""
select entity, week, prev_week, cast(floor((week - prev_week) / 7) as bigint) as gap_weeks
from (select entity, week, lag(week) over (partition by entity order by week) as prev_week from {{w_{_k}}} where rank = 1) x where week - prev_week > 8""")
    add(f"record_debut_no1_{_k}", f"select entity, first_week, weeks from {{sum_{_k}}} where debut_no1")
    add(f"record_no2_never_no1_{_k}", f"""
select entity, weeks_at_2 from (select w.entity, count(distinct w.week) as weeks_at_2 from {{w_{_k}}} w join {{sum_{_k}}} m on w.entity = m.entity where w.rank = 2 and m.peak > 1 group by w.entity) x
order by weeks_at_2 desc, entity limit 20""")
    add(f"record_reentries_{_k}", f"""
select entity, count(*) as reentries from (select entity, week - lag(week) over (partition by entity order by week) as gap from {{w_{_k}}}) x where gap > 8 group by entity order by reentries desc, entity limit 20""")
    add(f"record_longest_charting_{_k}", f"select entity, weeks, peak, no1_weeks, first_week from {{sum_{_k}}} order by weeks desc, peak, no1_weeks desc, first_week, entity limit 20")
    add(f"record_longest_no_top5_{_k}", f"select entity, weeks, peak, first_week from {{sum_{_k}}} where peak > 5 order by weeks desc, peak, first_week, entity limit 20")
    for _name, _dir in (("longest", "desc"), ("fastest", "asc")):
        add(f"record_{_name}_to_no1_{_k}", f"""
select m.entity, count(distinct w.week) as weeks_before from {{sum_{_k}}} m left join {{w_{_k}}} w on w.entity = m.entity and w.week >= m.first_week and w.week < m.first_peak_week
where m.peak = 1 group by m.entity order by weeks_before {_dir}, m.entity limit 20""")
    for _name, _dir in (("jump", "desc"), ("drop", "asc")):
        add(f"record_biggest_{_name}_{_k}", f"""
select entity, week, prev_rank, rank, prev_rank - rank as step from (select entity, week, rank, lag(rank) over (partition by entity order by week) as prev_rank, week - lag(week) over (partition by entity order by week) as gap
from {{w_{_k}}}) x where gap <= 8 order by step {_dir}, week, entity limit 15""")
    add(f"record_blocker_king_{_k}", f"""
select a.entity, count(distinct b.entity) as blocked from {{w_{_k}}} a join {{w_{_k}}} b on a.week = b.week and a.rank = 1 and b.rank = 2 join {{sum_{_k}}} m on m.entity = b.entity and m.peak = 2
group by a.entity order by blocked desc, a.entity limit 20""")
    add(f"record_blocked_map_{_k}", f"""
select a.entity, b.entity as blocked, count(*) as weeks from {{w_{_k}}} a join {{w_{_k}}} b on a.week = b.week and a.rank = 1 and b.rank = 2 join {{sum_{_k}}} m on m.entity = b.entity and m.peak = 2
group by a.entity, b.entity""")
    add(f"record_new_entry_ratio_{_k}", f"""
select w.week, count(*) filter (where w.week = m.first_week) as fresh, count(distinct w.entity) as entries, round(100e0 * count(*) filter (where w.week = m.first_week) / count(distinct w.entity), 1) as pct
from {{w_{_k}}} w join {{sum_{_k}}} m on w.entity = m.entity group by w.week""")
    add(f"record_span_{_k}", f"select entity, last_week - first_week as span from {{sum_{_k}}} order by span desc, entity limit 20")
    add(f"record_exit_after_no1_{_k}", f"select entity, greatest(0, cast(floor((last_week - first_peak_week) / 7) as bigint)) as weeks_after from {{sum_{_k}}} where peak = 1 order by weeks_after, entity limit 20")
    add(f"record_no1_margin_{_k}", f"""
select a.week, a.entity, a.plays - b.plays as gap, round(100e0 * (a.plays - b.plays) / a.plays, 1) as gap_pct from {{w_{_k}}} a join {{w_{_k}}} b on a.week = b.week and a.rank = 1 and b.rank = 2""")
    add(f"chart_movement_{_k}", f"""
select c.entity, c.week, case when p.entity is not null then 'stay' when h.first_week < c.week then 're' else 'new' end as movement
from (select * from {{w_{_k}}} where week = (select max(week) from {{w_{_k}}}) and rank = 1) c
left join {{w_{_k}}} p on p.entity = c.entity and p.week = c.week - 7 left join {{sum_{_k}}} h on h.entity = c.entity""")
    add(f"feed_top10_{_k}", f"select week, rank, entity, plays from {{w_{_k}}} where rank <= 10")
    add(f"feed_throwback_{_k}", f"select a.week, a.entity as now_no1, b.entity as year_ago_no1 from {{w_{_k}}} a join {{w_{_k}}} b on b.week = a.week - 364 and a.rank = 1 and b.rank = 1")

add("record_artist_simul", """
select c.artist_id, w.week, count(distinct w.entity) as tracks from {w_track} w join (select distinct week, track_id, artist_id from {cp}) c on c.week = w.week and c.track_id = w.entity
group by c.artist_id, w.week order by tracks desc, w.week, c.artist_id limit 15""")
add("record_album_simul", """
select c.album_id, w.week, count(distinct w.entity) as tracks from {w_track} w join (select distinct week, track_id, album_id from {cp}) c on c.week = w.week and c.track_id = w.entity
group by c.album_id, w.week order by tracks desc, w.week, c.album_id limit 15""")
add("record_top10_simul", """
select c.artist_id, w.week, count(distinct w.entity) as tracks from {w_track} w join (select distinct week, track_id, artist_id from {cp}) c on c.week = w.week and c.track_id = w.entity
where w.rank <= 10 group by c.artist_id, w.week order by tracks desc, w.week, c.artist_id limit 15""")
add("record_artist_most_no1", """
select c.artist_id, count(distinct w.entity) as no1_tracks, count(distinct w.week) as no1_weeks from {w_track} w join (select distinct week, track_id, artist_id from {cp}) c on c.week = w.week and c.track_id = w.entity
where w.rank = 1 group by c.artist_id order by no1_tracks desc, no1_weeks desc, c.artist_id limit 15""")
add("record_week_totals", """
select t.week, t.plays, t.tracks, a.entity as top_track, b.entity as top_album, d.entity as top_artist
from (select week, cast(sum(plays) as bigint) as plays, count(distinct track_id) as tracks from {cp} group by week) t
left join {w_track} a on a.week = t.week and a.rank = 1 left join {w_album} b on b.week = t.week and b.rank = 1 left join {w_artist} d on d.week = t.week and d.rank = 1""")
add("record_strongest_week", "select week, cast(sum(plays) as bigint) as plays from {cp} group by week order by plays desc, week desc limit 1")
add("record_self_replacement", """
select x.week, x.prev_entity, x.entity, x.album_id from (select w.week, w.entity, c.album_id, lag(w.entity) over (order by w.week) as prev_entity, lag(c.album_id) over (order by w.week) as prev_album, w.week - lag(w.week) over (order by w.week) as gap
from {w_track} w join (select distinct track_id, album_id from {cp}) c on c.track_id = w.entity where w.rank = 1) x where gap <= 8 and entity <> prev_entity and album_id = prev_album""")
add("credits_fan_out", "select week, artist_id, count(distinct track_id) as tracks, cast(sum(plays) as bigint) as plays from {cp} group by week, artist_id")
add("chart_year_coverage", """
select year, count(*) as weeks, min(week) as first_week, max(week) as last_week, cast(floor((max(week) - min(week)) / 7) as bigint) + 1 - count(*) as missing
from (select distinct week, cast(floor((week + 3) / 365.25e0) as bigint) as year from {w_track}) y group by year""")
add("aggregate_weekly_tracks", "select week, track_id, cast(sum(plays) as bigint) as play_count, cast(sum(ms) as bigint) as total_ms from {cp} group by week, track_id")
add("aggregate_weekly_sources", "select week, day, track_id, album_id, cast(sum(plays) as bigint) as play_count, cast(sum(ms) as bigint) as total_ms from {cp} group by week, day, track_id, album_id")
