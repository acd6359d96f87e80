"""Year-in-review tables and the remaining playback records."""

from __future__ import annotations

from playtide.plans.stats import add

for _e in ("track", "album", "artist"):
    k = f"{_e}_id"
    add(f"records_yearly_reign_{_e}", f"select year, {k}, plays from (select year, {k}, count(*) as plays, row_number() over (partition by year order by count(*) desc, sum(ms) desc, {k}) as n from {{e}} group by year, {k}) x where n = 1")
    add(f"records_monthly_peak_{_e}", f"select {k}, month, plays from (select {k}, month, count(*) as plays, row_number() over (partition by {k} order by count(*) desc, month) as n from {{e}} group by {k}, month) x where n = 1")
    add(f"records_click_share_{_e}", f"""
select {k}, count(*) as plays, round(100e0 * count(*) filter (where platform = 'click') / count(*), 1) as pct from {{e}} group by {k} having count(*) >= 10""")
    add(f"wrapped_play_rankings_{_e}", f"""
select year, {k}, plays, total_ms, row_number() over (partition by year order by plays desc, {k}) as by_plays, row_number() over (partition by year order by total_ms desc, {k}) as by_time
from (select year, {k}, count(*) as plays, cast(sum(ms) as bigint) as total_ms from {{e}} group by year, {k}) x""")
    add(f"wrapped_month_changes_{_e}", f"""
select {k}, month, plays, plays - lag(plays) over (partition by {k} order by month) as change from (select {k}, month, count(*) as plays from {{e}} group by {k}, month) x""")

add("records_view_share_days", "select day, count(*) as plays, round(100e0 * count(*) filter (where platform = 'view') / count(*), 1) as pct from {e} group by day having count(*) >= 20")
add("records_album_full_replays", """
select user_id, h.album_id, min(plays) as replays, count(*) as tracks from (select user_id, album_id, track_id, count(*) as plays from {e} group by user_id, album_id, track_id) h
join (select album_id, count(distinct track_id) as total from {e} group by album_id) a on a.album_id = h.album_id group by user_id, h.album_id, a.total having count(*) = a.total and a.total >= 2""")
add("records_shared_track_plays", """
select track_id, count(*) as plays, cast(sum(ms) as bigint) as total_ms from {e} where track_id in (select track_id from {e} group by track_id having count(distinct user_id) >= 2) group by track_id""")
add("wrapped_hero", "select user_id, year, count(*) as plays, count(distinct track_id) as tracks, count(distinct artist_id) as artists, count(distinct day) as active_days, cast(sum(ms) as bigint) as total_ms from {e} group by user_id, year")
add("wrapped_top_lists", "select user_id, artist_id, plays, n as place from (select user_id, artist_id, count(*) as plays, row_number() over (partition by user_id order by count(*) desc, artist_id) as n from {e} group by user_id, artist_id) x where n <= 3")
add("wrapped_album_completion", """
select user_id, album_id, heard, total, place from (select h.user_id, h.album_id, heard, total, row_number() over (partition by h.user_id order by cast(heard as double) / total desc, h.album_id) as place
 from (select user_id, album_id, count(distinct track_id) as heard from {e} group by user_id, album_id) h join (select album_id, count(distinct track_id) as total from {e} group by album_id) a on a.album_id = h.album_id
 where 2 * heard >= total) x where place <= 3""")
add("wrapped_collector", """
select user_id, round(100e0 * count(*) filter (where 10 * heard >= 7 * total) / count(*), 1) as pct from (select h.user_id, heard, total
 from (select user_id, album_id, count(distinct track_id) as heard from {e} group by user_id, album_id) h join (select album_id, count(distinct track_id) as total from {e} group by album_id) a on a.album_id = h.album_id) x group by user_id""")
add("wrapped_most_active_day", "select user_id, day, plays from (select user_id, day, count(*) as plays, row_number() over (partition by user_id order by count(*) desc, day) as n from {e} group by user_id, day) x where n = 1")
add("wrapped_late_night", """
select user_id, track_id, late, n as place from (select user_id, track_id, count(*) as late, row_number() over (partition by user_id order by count(*) desc, track_id) as n from {e} where hour between 0 and 5 group by user_id, track_id) x where n <= 3""")
add("wrapped_coverage_gaps", """
select user_id, day + 1 as gap_start, next_day - day - 1 as missing from (select user_id, day, lead(day) over (partition by user_id order by day) as next_day from (select distinct user_id, day from {e}) d) x where next_day - day > 1""")
add("wrapped_stable_runs", """
select artist_id, min(day) as first_day, max(day) as last_day, count(*) as days from (select day, artist_id, day - row_number() over (partition by artist_id order by day) as island from
 (select day, artist_id, row_number() over (partition by day order by count(*) desc, artist_id) as n from {e} group by day, artist_id) w where n = 1) i group by artist_id, island""")
add("wrapped_taste_drivers", """
select artist_id, round(100e0 * b / sum(b) over () - 100e0 * a / sum(a) over (), 3) as delta from (select artist_id, count(*) filter (where day <= mid) as a, count(*) filter (where day > mid) as b
 from {e} cross join (select cast(floor((min(day) + max(day)) / 2e0) as bigint) as mid from {e}) m group by artist_id) x""")
add("wrapped_record_scores", """
select track_id, round(ln(1e0 + plays) / max(ln(1e0 + plays)) over (), 6) as score from (select track_id, count(*) as plays from {e} group by track_id) x""")
add("wrapped_comparison", """
select user_id, recent, before, recent - before as change from (select user_id, count(*) filter (where day > mid) as recent, count(*) filter (where day <= mid) as before
 from {e} cross join (select cast(floor((min(day) + max(day)) / 2e0) as bigint) as mid from {e}) m group by user_id) x""")
add("wrapped_returning_tracks", """
select user_id, track_id, gap, day from (select user_id, track_id, day, gap, row_number() over (partition by user_id order by gap desc, track_id, day) as n from
 (select user_id, track_id, day, day - lag(day) over (partition by user_id, track_id order by day) as gap from (select distinct user_id, track_id, day from {e}) d) g where gap is not null) x where n <= 5""")
add("wrapped_relationship_types", """
select artist_id, case when days >= 20 and share >= 30 then 'anchor' when peak_share >= 50 then 'phase' when days >= 10 then 'steady' else 'guest' end as kind from
(select artist_id, count(distinct day) as days, 100e0 * count(*) / sum(count(*)) over () as share, max(month_share) as peak_share from (select artist_id, day, 100e0 * count(*) over (partition by artist_id, month) / count(*) over (partition by artist_id) as month_share from {e}) x
 group by artist_id) y""")
