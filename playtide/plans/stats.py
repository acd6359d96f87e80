"""Dashboard, analysis and leaderboard queries over logical plays and listened time.

Counts come from the events, time from the slices, each by the calendar it belongs to;
both sides are aggregated before they are aligned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playtide.plans.base import sql_query
from playtide.plans.timeline import TIMELINE_SQL, events, hours

PREFIX = TIMELINE_SQL + ",\nh24 as (select unnest(range(24)) as n),\nd7 as (select unnest(range(7)) as n),\nm12 as (select unnest(range(1, 13)) as n)"


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "e": events(spark, sf_dir), "s": hours(spark, sf_dir), "h24": spark.range(24).toDF("n"), "d7": spark.range(7).toDF("n"), "m12": spark.range(1, 13).toDF("n"),
    }


def add(name: str, text: str) -> None:
    sql_query(name, text, frames, PREFIX)


add("stats_summary", """
select a.plays, a.tracks, a.albums, a.artists, b.total_ms, b.active_days, round(b.total_ms / 3600000, 1) as hours
from (select count(*) as plays, count(distinct track_id) as tracks, count(distinct album_id) as albums, count(distinct artist_id) as artists from {e}) a
cross join (select cast(sum(ms) as bigint) as total_ms, count(distinct day) as active_days from {s}) b""")

add("stats_monthly_trend", """
select coalesce(a.month, b.month) as month, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms
from (select month, count(*) as plays from {e} group by month) a
full outer join (select month, cast(sum(ms) as bigint) as total_ms from {s} group by month) b on a.month = b.month""")

add("stats_hourly_distribution", """
select n as hour, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms from {h24} h
left join (select hour, count(*) as plays from {e} group by hour) a on a.hour = h.n
left join (select hour, cast(sum(ms) as bigint) as total_ms from {s} group by hour) b on b.hour = h.n""")

add("stats_weekday_distribution", """
select n as dow, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms from {d7} d
left join (select dow, count(*) as plays from {e} group by dow) a on a.dow = d.n
left join (select dow, cast(sum(ms) as bigint) as total_ms from {s} group by dow) b on b.dow = d.n""")

add("stats_month_of_year_distribution", """
select n as month_no, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms from {m12} m
left join (select cast(substring(month, 6, 2) as bigint) as k, count(*) as plays from {e} group by 1) a on a.k = m.n
left join (select cast(substring(month, 6, 2) as bigint) as k, cast(sum(ms) as bigint) as total_ms from {s} group by 1) b on b.k = m.n""")

add("stats_year_distribution", """
select coalesce(a.year, b.year) as year, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms
from (select year, count(*) as plays from {e} group by year) a
full outer join (select year, cast(sum(ms) as bigint) as total_ms from {s} group by year) b on a.year = b.year""")

add("stats_daily_trend", """
select coalesce(a.day, b.day) as day, coalesce(a.plays, 0) as plays, coalesce(b.total_ms, 0) as total_ms
from (select day, count(*) as plays from {e} group by day) a
full outer join (select day, cast(sum(ms) as bigint) as total_ms from {s} group by day) b on a.day = b.day""")

add("stats_cumulative_trend", """
select day, cast(sum(plays) over (order by day) as bigint) as plays, cast(sum(total_ms) over (order by day) as bigint) as total_ms
from (select day, cast(sum(p) as bigint) as plays, cast(sum(m) as bigint) as total_ms
      from (select day, 1 as p, 0 as m from {e} union all select day, 0, ms from {s}) group by day)""")

add("stats_listening_heatmap", """
select d.n as dow, h.n as hour, coalesce(c.plays, 0) as plays from {d7} d cross join {h24} h
left join (select dow, hour, count(*) as plays from {e} group by dow, hour) c on c.dow = d.n and c.hour = h.n""")

add("stats_yearly_heatmaps", "select year, dow, hour, count(*) as plays from {e} group by year, dow, hour")

add("stats_late_night_ratio", """
select year, count(*) as plays, count(*) filter (where hour between 0 and 5) as late,
  round(100e0 * count(*) filter (where hour between 0 and 5) / count(*), 1) as late_pct from {e} group by year""")

add("stats_late_night_top_tracks", """
select track_id, count(*) as plays, cast(sum(ms) as bigint) as total_ms from {e} where hour between 0 and 5
group by track_id order by plays desc, total_ms desc, track_id limit 10""")

add("stats_weekday_weekend", """
select n as hour, coalesce(weekday, 0) as weekday, coalesce(weekend, 0) as weekend from {h24} h
left join (select hour, count(*) filter (where dow < 5) as weekday, count(*) filter (where dow >= 5) as weekend from {e} group by hour) c on c.hour = h.n""")

add("stats_platform_distribution", "select platform, count(*) as plays, count(distinct user_id) as listeners from {e} group by platform")

add("stats_platform_hourly", """
select platform, hour, plays, round(100e0 * plays / sum(plays) over (partition by hour), 1) as pct_of_hour,
  first_value(hour) over (partition by platform order by plays desc, hour) as peak_hour
from (select platform, hour, count(*) as plays from {e} group by platform, hour)""")

add("stats_platform_by_month", "select platform, month, count(*) as plays from {e} group by platform, month")

add("stats_annual_timeline", """
select a.year, plays, total_ms, tracks, artists, t.track_id as top_track from
(select year, count(*) as plays, cast(sum(ms) as bigint) as total_ms, count(distinct track_id) as tracks, count(distinct artist_id) as artists from {e} group by year) a
join (select year, track_id, row_number() over (partition by year order by count(*) desc, track_id) as n from {e} group by year, track_id) t on a.year = t.year and t.n = 1""")

add("stats_monthly_drilldown", """
select month, track_id, plays, n as place from
(select month, track_id, count(*) as plays, row_number() over (partition by month order by count(*) desc, track_id) as n from {e} group by month, track_id) x where n <= 5""")

for _entity in ("track", "album", "artist"):
    add(f"leaderboard_{_entity}_by_plays", f"""
select {_entity}_id, count(*) as plays, cast(sum(ms) as bigint) as total_ms from {{e}} group by {_entity}_id order by plays desc, total_ms desc, {_entity}_id limit 20""")
    add(f"leaderboard_{_entity}_by_time", f"""
select {_entity}_id, cast(sum(ms) as bigint) as total_ms, count(distinct day) as active_days from {{s}} group by {_entity}_id order by total_ms desc, {_entity}_id limit 20""")

add("stats_listener_summary", """
select a.user_id, plays, coalesce(total_ms, 0) as total_ms, tracks, active_days from
(select user_id, count(*) as plays, count(distinct track_id) as tracks, count(distinct day) as active_days from {e} group by user_id) a
left join (select user_id, cast(sum(ms) as bigint) as total_ms from {s} group by user_id) b on a.user_id = b.user_id""")

add("stats_behavior", """
select platform, count(*) as plays, round(100e0 * count(*) / sum(count(*)) over (), 1) as share, count(*) filter (where hour between 0 and 5) as late,
  round(100e0 * count(*) filter (where dow >= 5) / count(*), 1) as weekend_pct from {e} group by platform""")

add("stats_play_dates", "select day, count(*) as plays from {e} group by day")

add("stats_month_over_month", """
select month, plays, plays - lag(plays) over (order by month) as change from (select month, count(*) as plays from {e} group by month)""")

add("stats_period_last_28_days", """
select count(*) as plays, count(distinct track_id) as tracks, cast(sum(ms) as bigint) as total_ms from {e} where day > (select max(day) from {e}) - 28""")

add("stats_artist_tiers", """
select artist_id, total_ms, n as place, case when n < 5 then 'core' when n < 15 then 'regular' else 'casual' end as tier from
(select artist_id, cast(sum(ms) as bigint) as total_ms, row_number() over (order by sum(ms) desc, artist_id) as n from {s} group by artist_id) x""")

add("stats_top_tracks_of_album", """
select album_id, track_id, plays, n as place from
(select album_id, track_id, count(*) as plays, row_number() over (partition by album_id order by count(*) desc, track_id) as n from {e} group by album_id, track_id) x where n <= 3""")

add("stats_versus_tracks", """
select day, count(*) filter (where track_id = 1) as plays_a, count(*) filter (where track_id = 2) as plays_b from {e} where track_id in (1, 2) group by day""")
