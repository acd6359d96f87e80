"""Playback records: binges, streaks, reigns, milestones, discoveries and habits."""

from __future__ import annotations

from playtide.operators.habits import no_repeat_runs
from playtide.plans.base import query
from playtide.plans.stats import PREFIX, add
from playtide.plans.timeline import events

for _e in ("track", "album", "artist"):
    k = f"{_e}_id"
    add(f"records_daily_binge_{_e}", f"""
select day, {k}, plays from (select day, {k}, count(*) as plays, row_number() over (partition by day order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by day, {k}) x
where n = 1 order by plays desc, day, {k} limit 50""")
    add(f"records_daily_duration_{_e}", f"""
select day, {k}, total_ms from (select day, {k}, cast(sum(ms) as bigint) as total_ms, row_number() over (partition by day order by sum(ms) desc, {k}) as n from {{s}} group by day, {k}) x
where n = 1 order by total_ms desc, day, {k} limit 50""")
    add(f"records_longest_day_streak_{_e}", f"""
select {k}, length, start_day from (select {k}, island, count(*) as length, min(day) as start_day, row_number() over (partition by {k} order by count(*) desc, min(day)) as n
  from (select {k}, day, day - row_number() over (partition by {k} order by day) as island from (select distinct {k}, day from {{e}}) d) i group by {k}, island) x where n = 1""")
    add(f"records_longest_span_{_e}", f"select {k}, min(day) as first_day, max(day) as last_day, max(day) - min(day) + 1 as span from {{e}} group by {k}")
    add(f"records_active_months_{_e}", f"select {k}, count(distinct month) as months from {{e}} group by {k}")
    add(f"records_daily_champion_{_e}", f"""
select {k}, count(*) as days from (select day, {k}, row_number() over (partition by day order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by day, {k}) x where n = 1 group by {k}""")
    add(f"records_monthly_reign_{_e}", f"""
select {k}, count(*) as months from (select month, {k}, row_number() over (partition by month order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by month, {k}) x where n = 1 group by {k}""")
    add(f"records_champion_run_{_e}", f"""
select {k}, length, start_day from (select {k}, count(*) as length, min(day) as start_day, row_number() over (partition by {k} order by count(*) desc, min(day)) as n
  from (select {k}, day, day - row_number() over (partition by {k} order by day) as island
        from (select day, {k}, row_number() over (partition by day order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by day, {k}) w where n = 1) i
  group by {k}, island) x where n = 1 and length >= 2""")
    add(f"records_fastest_milestone_{_e}", f"""
select {k}, max(case when n = 50 then day end) - max(case when n = 1 then day end) as days from
(select {k}, day, row_number() over (partition by {k} order by counted_us, event_id) as n from {{e}}) x where n in (1, 50) group by {k} having max(n) = 50""")
    add(f"records_hourly_dominance_{_e}", f"""
select hour, {k}, plays from (select hour, {k}, count(*) as plays, row_number() over (partition by hour order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by hour, {k}) x where n = 1""")
    add(f"records_discovery_day_{_e}", f"""
select day, fresh, rank() over (order by fresh desc) as place from (select day, count(*) as fresh from (select {k}, min(day) as day from {{e}} group by {k}) f group by day) x""")
    add(f"records_marathon_{_e}", f"""
select {k}, length, first_us from (select user_id, {k}, island, count(*) as length, min(counted_us) as first_us, row_number() over (partition by {k} order by count(*) desc, min(counted_us), user_id) as n
  from (select user_id, {k}, counted_us, row_number() over (partition by user_id order by counted_us, event_id) - row_number() over (partition by user_id, {k} order by counted_us, event_id) as island from {{e}}) i
  group by user_id, {k}, island) x where n = 1""")

add("records_busiest_days", "select day, count(*) as plays, count(distinct track_id) as tracks from {e} group by day order by plays desc, day limit 50")
add("records_active_streak", """
select user_id, length, start_day from (select user_id, count(*) as length, min(day) as start_day, row_number() over (partition by user_id order by count(*) desc, min(day)) as n
  from (select user_id, day, day - row_number() over (partition by user_id order by day) as island from (select distinct user_id, day from {e}) d) i group by user_id, island) x where n = 1""")
add("records_platform_switch_day", """
select user_id, day, switches from (select user_id, day, count(*) as switches, row_number() over (partition by user_id order by count(*) desc, day) as n
  from (select user_id, day, platform, lag(platform) over (partition by user_id, day order by counted_us, event_id) as prev from {e}) p where prev is not null and prev <> platform group by user_id, day) x where n = 1""")
add("records_listener_milestones", """
select user_id, n as milestone, event_id, day from (select user_id, event_id, day, row_number() over (partition by user_id order by counted_us, event_id) as n from {e}) x where n in (1, 10, 25, 50, 100, 250)""")
add("records_late_night_trajectory", """
select month, count(*) as plays, count(*) filter (where hour between 0 and 4) as late, count(*) >= 500 as qualified from {e} group by month""")
add("records_weekday_preference", "select dow, count(*) as plays, count(distinct day) as days, round(count(*) / count(distinct day), 2) as plays_per_day from {e} group by dow")
add("records_shared_tracks", "select track_id, count(distinct user_id) as listeners from {e} group by track_id having count(distinct user_id) >= 2")
add("records_late_night_peak_day", "select day, count(*) as late from {e} where hour between 0 and 4 group by day order by late desc, day limit 10")
add("records_platform_reign", "select platform, plays, row_number() over (order by plays desc, platform) as place, round(100e0 * plays / sum(plays) over (), 1) as share from (select platform, count(*) as plays from {e} group by platform)")
add("wrapped_daily_grid", "select year, month, day, count(*) as plays from {e} group by year, month, day")
add("wrapped_edge_listens", "select user_id, min(hour) as earliest_hour, max(hour) as latest_hour, min_by(event_id, counted_us) as first_event, max(counted_us) as last_us from {e} group by user_id")
add("wrapped_two_scores", """
select user_id, round(least(100e0, 100e0 * count(distinct track_id) / count(*) * 100 / 40), 1) as explorer, round(least(100e0, 100e0 * count(*) filter (where hour between 0 and 5) / count(*) * 100 / 50), 1) as night_owl,
  count(*) as plays from {e} group by user_id""")
add("wrapped_new_artists", """
select month, count(*) as new_pairs from (select user_id, artist_id, min(month) as month from {e} group by user_id, artist_id) f group by month""")
add("wrapped_monthly_leaders", """
select month, artist_id, plays, total_ms from (select a.month, a.artist_id, plays, coalesce(total_ms, 0) as total_ms, row_number() over (partition by a.month order by plays desc, coalesce(total_ms, 0) desc, a.artist_id) as n
 from (select month, artist_id, count(*) as plays from {e} group by month, artist_id) a
 left join (select month, artist_id, cast(sum(ms) as bigint) as total_ms from {s} group by month, artist_id) b on a.month = b.month and a.artist_id = b.artist_id) x where n = 1""")
add("wrapped_longest_love", "select user_id, track_id, span from (select user_id, track_id, max(day) - min(day) as span, row_number() over (partition by user_id order by max(day) - min(day) desc, track_id) as n from {e} group by user_id, track_id) x where n = 1")
add("wrapped_entity_relationships", """
select artist_id, count(*) as plays, count(distinct day) as days, count(distinct month) as months, max(day) - min(day) + 1 as span, count(distinct track_id) as tracks from {e} group by artist_id""")
add("home_idle_tracks", """
select user_id, track_id, plays, last_day from (select user_id, track_id, count(*) as plays, max(day) as last_day from {e} group by user_id, track_id) x
where plays >= 3 and last_day < (select max(day) from {e}) - 10""")
add("home_recent_leaders", """
select artist_id, count(*) filter (where day > last_day - 7) as recent, count(*) filter (where day between last_day - 13 and last_day - 7) as before
from {e} cross join (select max(day) as last_day from {e}) m group by artist_id""")

_GREEDY = PREFIX + """,
w as (select user_id, list(track_id order by counted_us, event_id) as l from e group by user_id),
f as (select user_id, list_reduce(l, lambda a, x: case when list_contains(a[2:], x) then [greatest(a[1], len(a) - 1), x] else list_append(a, x) end, [0::bigint]) as r from w)
select user_id, greatest(r[1], len(r) - 1)::bigint as length from f"""


query("records_no_repeat_streak", _GREEDY)(lambda s, d: no_repeat_runs(events(s, d), "track_id"))
