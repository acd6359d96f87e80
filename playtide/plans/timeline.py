"""Timeline queries, over the raw stop events of many listeners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY, US_PER_HOUR, PlayFilters
from playtide.operators import timeline as T
from playtide.plans.base import query
from playtide.sources.plays import RAW_PLAYS_SQL, raw_plays

#: Rules of the queries: the gap is wide, since the supplied events of a listener are hours apart.
RULES = PlayFilters(min_ms=5_000, dynamic_threshold=True, max_gap_minutes=24 * 60)


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.runs(raw_plays(spark, sf_dir), RULES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective logical plays with their local calendar."""
    return T.with_calendar(T.effective(T.logical_plays(run_rows(spark, sf_dir), RULES), RULES))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listened time by local hour."""
    return T.hour_slices(T.listening_intervals(run_rows(spark, sf_dir)))


_S, _D, _H = LOCAL_SHIFT_US, US_PER_DAY, US_PER_HOUR
TIMELINE_SQL = f"""with {RAW_PLAYS_SQL},
t1 as (select *, end_us - ms * 1000 as start_us from raw_plays),
t2 as (select *, row_number() over o as pos_all, start_us - lag(end_us) over o as gap, track_id is distinct from lag(track_id) over o as moved
       from t1 window o as (partition by user_id order by end_us, play_id)),
t3 as (select *, sum(case when pos_all = 1 or moved or gap > {RULES.max_gap_minutes * 60_000_000} or gap < -{RULES.overlap_tolerance_us} then 1 else 0 end)
              over (partition by user_id order by end_us, play_id rows unbounded preceding)::bigint as run_no from t2),
t4 as (select *, sum(ms) over (partition by user_id, run_no order by end_us, play_id rows unbounded preceding)::bigint as cum_end from t3),
t5 as (select *, cum_end - ms as cum_start from t4),
run_rows as (select *, max(start_us - cum_start * 1000) over (partition by user_id, run_no order by end_us, play_id rows unbounded preceding) + cum_start * 1000 as eff_start_us,
              row_number() over (partition by user_id, run_no order by end_us, play_id) as pos,
              first_value(gap < -{RULES.overlap_tolerance_us}) over (partition by user_id, run_no order by end_us, play_id) as overlap_split,
              first_value(play_id) over (partition by user_id, run_no order by end_us, play_id) as anchor from t5),
heads as (select user_id, run_no, sum(ms)::bigint as total, any_value(anchor) as anchor, arg_min(duration_ms, pos) as dur, arg_min(track_id, pos) as track_id, arg_min(album_id, pos) as album_id,
              arg_min(artist_id, pos) as artist_id, arg_min(platform, pos) as platform from run_rows group by all),
planned as (select *, total // dur as full_n, greatest({RULES.min_ms}, floor(dur * {RULES.ratio})::bigint) as lim from heads where total > 0),
ev1 as (select *, unnest(range(0, full_n + case when total % dur > 0 and total % dur >= lim then 1 else 0 end)) as ordinal from planned),
ev2 as (select *, case when ordinal < full_n then dur else total - ordinal * dur end as ms, case when ordinal < full_n then (ordinal + 1) * dur else full_n * dur + lim end as qualify from ev1),
logical as (select e.user_id, e.anchor, e.ordinal, e.track_id, e.album_id, e.artist_id, e.platform, e.dur as duration_ms, e.ms, e.lim,
              r.eff_start_us + (e.qualify - r.cum_start) * 1000 as counted_us, e.anchor || ':' || e.ordinal as event_id
            from ev2 e join run_rows r on e.user_id = r.user_id and e.run_no = r.run_no and r.cum_start < e.qualify and e.qualify <= r.cum_end),
ev4 as (select *, cast(floor((counted_us + {_S}) / {_D}) as bigint) as day, cast(floor((counted_us + {_S}) / {_H}) as bigint) as hour_no from logical where ms >= lim),
e as (select *, hour_no - day * 24 as hour, (day + 3) % 7 as dow, strftime(date '1970-01-01' + day::int, '%Y-%m') as month, year(date '1970-01-01' + day::int)::bigint as year from ev4),
iv as (select *, eff_start_us + ms * 1000 as eff_end_us from run_rows where ms > 0),
sl as (select *, unnest(range((eff_start_us + {_S}) // {_H}, (eff_end_us + {_S} - 1) // {_H} + 1)) as piece from iv),
s1 as (select user_id, track_id, album_id, artist_id, platform, play_id, piece, (least(eff_end_us + {_S}, (piece + 1) * {_H}) - greatest(eff_start_us + {_S}, piece * {_H})) // 1000 as ms from sl),
s as (select *, piece // 24 as day, piece % 24 as hour, (piece // 24 + 3) % 7 as dow, strftime(date '1970-01-01' + (piece // 24)::int, '%Y-%m') as month,
        year(date '1970-01-01' + (piece // 24)::int)::bigint as year from s1)"""


@query("timeline_runs", TIMELINE_SQL + " select play_id, user_id, run_no, ms, cum_start, cum_end, eff_start_us, coalesce(overlap_split, false) as overlap_split from run_rows")
def timeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(spark, sf_dir).select("play_id", "user_id", "run_no", "ms", "cum_start", "cum_end", "eff_start_us", "overlap_split")


@query("timeline_logical_plays", TIMELINE_SQL + " select event_id, user_id, ordinal, track_id, ms, counted_us from logical")
def timeline_logical_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.logical_plays(run_rows(spark, sf_dir), RULES).select("event_id", "user_id", "ordinal", "track_id", "ms", "counted_us")


@query("timeline_effective_plays", TIMELINE_SQL + " select event_id, track_id, ms, day, hour, dow, month, year from e")
def timeline_effective_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "track_id", "ms", "day", "hour", "dow", "month", "year")


@query("timeline_listening_intervals", TIMELINE_SQL + " select play_id, user_id, ms, eff_start_us, eff_end_us from iv")
def timeline_listening_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.listening_intervals(run_rows(spark, sf_dir)).select("play_id", "user_id", "ms", "eff_start_us", "eff_end_us")


@query("timeline_hour_slices", TIMELINE_SQL + " select play_id, day, hour, ms from s")
def timeline_hour_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).select("play_id", "day", "hour", "ms")


_WEEK = f"""{TIMELINE_SQL},
wk as (select *, unnest(range((eff_start_us + {_S} - 12 * {_H}) // {_D}, (eff_end_us + {_S} - 12 * {_H} - 1) // {_D} + 1)) as piece from iv),
ws as (select *, piece - (piece + 3 - 4 + 7) % 7 as week, (least(eff_end_us + {_S} - 12 * {_H}, (piece + 1) * {_D}) - greatest(eff_start_us + {_S} - 12 * {_H}, piece * {_D})) // 1000 as slice_ms from wk),
wd as (select track_id, (counted_us + {_S} - 12 * {_H}) // {_D} as d, 1 as play_count, 0 as total_ms from e),
joint as (select track_id, d - (d + 3 - 4 + 7) % 7 as week, play_count, total_ms from wd union all select track_id, week, 0, slice_ms from ws)"""


@query("timeline_weekly_weighted", _WEEK + " select week, track_id, sum(play_count)::bigint as play_count, sum(total_ms)::bigint as total_ms from joint group by all")
def timeline_weekly_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the moment that counted, time by the slices; weeks start on Friday at noon."""
    r = run_rows(spark, sf_dir)
    counted = T.effective(T.logical_plays(r, RULES), RULES)
    rows = T.weighted(counted, T.week_slices(T.listening_intervals(r), 4, 12), 4, 12)
    return rows.groupBy("week", "track_id").agg(F.sum("play_count").alias("play_count"), F.sum("total_ms").alias("total_ms"))
