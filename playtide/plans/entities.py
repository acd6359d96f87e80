"""Entity pages, raw scans, source inventory and incremental maintenance over the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playtide.plans import stats
from playtide.plans.base import sql_query
from playtide.plans.timeline import run_rows
from playtide.sources.plays import raw_plays


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return stats.frames(spark, sf_dir) | {"raw_plays": raw_plays(spark, sf_dir), "run_rows": run_rows(spark, sf_dir)}


def add(name: str, text: str) -> None:
    sql_query(name, text, frames, stats.PREFIX)


for _e in ("track", "album", "artist"):
    k = f"{_e}_id"
    add(f"entity_profile_{_e}", f"""
select a.{k}, plays, tracks, listeners, active_days, first_us, last_us, coalesce(total_ms, 0) as total_ms, top_hour
from (select {k}, count(*) as plays, count(distinct track_id) as tracks, count(distinct user_id) as listeners, count(distinct day) as active_days, min(counted_us) as first_us, max(counted_us) as last_us
      from {{e}} group by {k}) a
left join (select {k}, cast(sum(ms) as bigint) as total_ms from {{s}} group by {k}) b on a.{k} = b.{k}
join (select {k}, hour as top_hour, row_number() over (partition by {k} order by count(*) desc, hour) as n from {{e}} group by {k}, hour) h on h.{k} = a.{k} and h.n = 1""")
    add(f"entity_play_dates_{_e}", f"select {k}, day, count(*) as plays from {{e}} group by {k}, day")
    add(f"entity_versus_{_e}", f"""
select {k}, plays, active_days, round(cast(plays as double) / active_days, 2) as per_day, round(100e0 * plays / sum(plays) over (), 2) as share
from (select {k}, count(*) as plays, count(distinct day) as active_days from {{e}} where {k} in (0, 1, 2) group by {k}) x""")

add("entity_plays_page", "select event_id, counted_us, ms from {e} where track_id = 3 order by counted_us desc, event_id limit 25 offset 25")
add("entity_tracks_of_artist", """
select artist_id, track_id, plays, row_number() over (partition by artist_id order by plays desc, track_id) as place
from (select artist_id, track_id, count(*) as plays from {e} group by artist_id, track_id) x""")
add("stats_weekly_timeline", """
select year, week, plays, total_ms, rank() over (partition by year order by plays desc) as place
from (select year, day - (day + 3) % 7 as week, count(*) as plays, cast(sum(ms) as bigint) as total_ms from {e} group by year, day - (day + 3) % 7) x""")
add("stats_recent_plays", "select event_id, counted_us, track_id, album_id from {e} order by counted_us desc, event_id limit 50")
add("stats_daily_metrics", "select plays, active_days, round(cast(plays as double) / active_days, 2) as per_day from (select count(*) as plays, count(distinct day) as active_days from {e}) x")
add("stats_fixed_threshold", "select track_id, count(*) as plays from {e} where ms >= greatest(5000, floor(duration_ms * 0.5e0)) group by track_id")
add("stats_genre_coverage", """
select round(100e0 * sum(case when album_id <> 4 then ms else 0 end) / sum(ms), 2) as covered_pct, cast(sum(ms) as bigint) as total_ms from {s}""")
add("stats_axis_gaps", "select artist_id, album_id, cast(sum(ms) as bigint) as total_ms from {s} where album_id = 4 group by artist_id, album_id order by total_ms desc, artist_id limit 10")
add("stats_axis_distribution", """
select album_id, total_ms, round(100e0 * total_ms / sum(total_ms) over (), 2) as share from (select album_id, cast(sum(ms) as bigint) as total_ms from {s} group by album_id) x""")

add("raw_page", "select play_id, end_us, track_id, platform from {raw_plays} where ms >= 30000 and track_id is not null and platform like '%ic%' order by end_us desc, play_id limit 25 offset 50")
add("raw_page_total", "select count(*) as total from {raw_plays} where ms >= 30000 and track_id is not null and platform like '%ic%'")
add("raw_play_dates", "select cast(floor((end_us + 28800000000) / 86400000000e0) as bigint) as day, count(*) as plays from {raw_plays} group by 1")
add("source_inventory", "select platform, count(*) as records, min(end_us) as first_us, max(end_us) as last_us, count(distinct user_id) as listeners from {raw_plays} group by platform")
add("source_overlaps", """
select a.platform as a, b.platform as b, greatest(a.lo, b.lo) as from_us, least(a.hi, b.hi) as to_us
from (select platform, min(end_us) as lo, max(end_us) as hi from {raw_plays} group by platform) a
join (select platform, min(end_us) as lo, max(end_us) as hi from {raw_plays} group by platform) b on a.platform < b.platform and a.lo <= b.hi and b.lo <= a.hi""")
add("source_duplicates", "select user_id, end_us, track_id, count(*) as copies from {raw_plays} group by user_id, end_us, track_id having count(*) > 1")

add("change_logical_delta", """
select track_id, album_id, cast(sum(n) as bigint) as plays, cast(sum(t) as bigint) as total_ms from
(select track_id, album_id, 1 as n, ms as t from {e} where day > (select max(day) from {e}) - 9 union all
 select track_id, album_id, -1, -ms from {e} where day < (select max(day) from {e}) - 2) d group by track_id, album_id having sum(n) <> 0 or sum(t) <> 0""")
add("change_projected_delta", """
select artist_id, cast(sum(n) as bigint) as plays from
(select artist_id, 1 as n from {e} where day > (select max(day) from {e}) - 9 union all select artist_id, -1 from {e} where day < (select max(day) from {e}) - 2) d group by artist_id having sum(n) <> 0""")
add("change_contribution_weeks", """
select distinct week from (
 (select day - (day + 3) % 7 as week, track_id, count(*) as n from {e} group by 1, 2 except all select day - (day + 3) % 7, track_id, count(*) from {e} where track_id <> 3 group by 1, 2)
 union all (select day - (day + 3) % 7, track_id, count(*) from {e} where track_id <> 3 group by 1, 2 except all select day - (day + 3) % 7, track_id, count(*) from {e} group by 1, 2)) x""")
add("change_year_state", """
select year, month, plays, cast(sum(plays) over (order by month) as bigint) as prefix_plays, digest, cast(sum(digest) over (order by month) as bigint) as prefix_digest
from (select year, month, count(*) as plays, cast(sum(track_id * 31 + hour) as bigint) as digest from {e} group by year, month) x""")
