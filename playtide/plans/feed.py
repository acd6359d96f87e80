"""Further chart tables: cross-level scores, counts, comparisons and the rule-based feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.operators import charts as C
from playtide.plans.base import query, sql_query
from playtide.plans.charts import CHART_SQL, KINDS, _score_sql, add, frames, weekly
from playtide.sources.publish import scratch


def scored(name: str, text: str) -> None:
    """Register SQL that also reads the tracks' power scores, ``scores``."""
    sql_query(name, text, lambda s, d: frames(s, d) | {"scores": C.power_scores(weekly("track")(s, d), "track")}, CHART_SQL + _score_sql("track"))


for _k in ("album", "artist"):
    add(f"chart_track_counts_{_k}", f"""
select c.{_k}_id, count(*) as tracks, min(m.peak) as best_peak, cast(sum(m.weeks) as bigint) as weeks, count(*) filter (where m.peak = 1) as top1, count(*) filter (where m.peak <= 5) as top5,
  count(*) filter (where m.peak <= 10) as top10, cast(sum(m.no1_weeks) as bigint) as no1_weeks from {{sum_track}} m join (select distinct track_id, {_k}_id from {{cp}}) c on c.track_id = m.entity group by c.{_k}_id""")
    add(f"chart_tracks_by_week_{_k}", f"""
select w.week, c.{_k}_id, count(distinct w.entity) as tracks, min(w.rank) as best from {{w_track}} w join (select distinct week, track_id, {_k}_id from {{cp}}) c on c.week = w.week and c.track_id = w.entity group by w.week, c.{_k}_id""")

scored("hall_of_fame", "select entity, power, power_rank, peak, weeks, no1_weeks from {scores} where power_rank <= 50 and peak <= 10")

for _k in KINDS:
    w, m = f"{{w_{_k}}}", f"{{sum_{_k}}}"
    add(f"chart_gaps_{_k}", f"""
select entity, week, rank, case when lead(week) over (partition by entity order by week) - week > 9 then 1 else 0 end as gap_after from {w}""")
    add(f"chart_versus_{_k}", f"""
select coalesce(a.week, b.week) as week, a.rank as rank_a, b.rank as rank_b, a.plays as plays_a, b.plays as plays_b
from (select * from {w} where entity = (select min(entity) from {m})) a full outer join (select * from {w} where entity = (select max(entity) from {m})) b on a.week = b.week""")
    add(f"chart_directory_{_k}", f"select entity, weeks, peak, last_week from {m} where cast(entity as varchar(20)) like '%1%'")
    add(f"feed_no1_{_k}", f"""
select x.week, x.entity, case when x.week = h.first_week then 'debut' when prev = x.entity and gap <= 8 then 'stays' when before > 0 then 'returns' else 'climbs' end as event
from (select week, entity, lag(entity) over (order by week) as prev, week - lag(week) over (order by week) as gap, row_number() over (partition by entity order by week) - 1 as before from {w} where rank = 1) x
join {m} h on h.entity = x.entity""")
    add(f"feed_debuts_{_k}", f"select w.week, w.entity, w.rank from {w} w join {m} h on h.entity = w.entity and h.first_week = w.week where w.rank <= 20")
    for _name, _dir in (("jump", "desc"), ("drop", "asc")):
        add(f"feed_{_name}_{_k}", f"""
select week, entity, step from (select week, entity, step, row_number() over (partition by week order by step {_dir}, entity) as n from
 (select week, entity, lag(rank) over (partition by entity order by week) - rank as step, week - lag(week) over (partition by entity order by week) as gap from {w}) x where gap <= 8) y where n = 1""")
    add(f"feed_longevity_{_k}", f"select entity, week, so_far from (select entity, week, row_number() over (partition by entity order by week) as so_far from {w}) r where so_far in (5, 10, 20, 50, 100)")
    add(f"feed_weekly_race_{_k}", f"select a.week, a.entity, b.entity as rival, a.plays - b.plays as gap from {w} a join {w} b on a.week = b.week and a.rank = 1 and b.rank = 2 where 10 * (a.plays - b.plays) <= a.plays")
    add(f"feed_market_overview_{_k}", f"""
select w.week, count(*) as entries, count(*) filter (where p.entity is null) as turnover, cast(sum(w.plays) as bigint) as plays from {w} w left join {w} p on p.entity = w.entity and p.week = w.week - 7 group by w.week""")
    add(f"feed_alltime_rank_{_k}", f"""
select week, entity, so_far, row_number() over (partition by week order by so_far desc, entity) as place
from (select week, entity, cast(sum(plays) over (partition by entity order by week rows unbounded preceding) as bigint) as so_far from {w}) x""")
    add(f"record_market_share_{_k}", f"select week, entity, plays, round(100e0 * plays / sum(plays) over (partition by week), 2) as share from {w}")
    add(f"record_weeks_at_rank_{_k}", f"select entity, rank, count(*) as weeks from {w} group by entity, rank")
    add(f"record_top_weeks_{_k}", f"""
select entity, count(*) filter (where rank = 1) as top1, count(*) filter (where rank <= 3) as top3, count(*) filter (where rank <= 5) as top5, count(*) filter (where rank <= 10) as top10 from {w} group by entity""")
    add(f"record_biggest_week_{_k}", f"select entity, week, plays from (select entity, week, plays, row_number() over (partition by entity order by plays desc, week) as n from {w}) x where n = 1")
    add(f"record_lowest_debut_to_no1_{_k}", f"""
select w.entity, w.rank as debut_rank, w.week from {w} w join {m} h on h.entity = w.entity and h.first_week = w.week where h.peak = 1 order by debut_rank desc, w.week, w.entity limit 20""")

add("feed_artist_milestones", """
select artist_id, week, weeks from (select artist_id, week, row_number() over (partition by artist_id order by week) as weeks from
 (select distinct c.artist_id, w.week from {w_track} w join (select distinct week, track_id, artist_id from {cp}) c on c.week = w.week and c.track_id = w.entity) d) x where weeks in (10, 25, 50, 100, 200)""")


@query("feed_personal_weekly", CHART_SQL + "\n" + "select week, cast(sum(plays) as bigint) as plays, cast(sum(ms) as bigint) as total_ms, count(distinct track_id) as tracks, count(distinct artist_id) as artists from cp group by week")
def feed_personal_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays, time and numbers of tracks and artists of each week, counted from one row a track and one an artist."""
    cp = scratch(frames(spark, sf_dir)["cp"].select("week", "track_id", "artist_id", "plays", "ms"))
    tracks = cp.groupBy("week", "track_id").agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms"))
    weeks = tracks.groupBy("week").agg(F.sum("plays").alias("plays"), F.sum("ms").alias("total_ms"), F.count("track_id").alias("tracks"))
    artists = cp.select("week", "artist_id").distinct().groupBy("week").agg(F.count("artist_id").alias("artists"))
    same = F.col("week").eqNullSafe(F.col("_week"))
    return weeks.join(artists.withColumnRenamed("week", "_week"), same).select("week", "plays", "total_ms", "tracks", "artists")


add("feed_playback_milestone", """
select week, cast(floor(total / 10000e0) as bigint) as step from (select week, plays, cast(sum(plays) over (order by week) as bigint) as total from (select week, sum(plays) as plays from {cp} group by week) a) b
where floor(total / 10000e0) > floor((total - plays) / 10000e0)""")
add("feed_trending", """
select week, track_id, plays, place from (select week, track_id, cast(sum(plays) as bigint) as plays, row_number() over (partition by week order by sum(plays) desc, track_id) as place from {cp} group by week, track_id) x where place <= 3""")
add("aggregate_weekly_albums", "select week, album_id, cast(sum(plays) as bigint) as play_count, cast(sum(ms) as bigint) as total_ms from {cp} group by week, album_id")
add("aggregate_weekly_artists", "select week, artist_id, cast(sum(plays) as bigint) as play_count, cast(sum(ms) as bigint) as total_ms from {cp} group by week, artist_id")
add("chart_complete_weeks", "select week, entity, rank from {w_track} where week < (select max(week) from {cp})")
add("chart_representative_album", """
select track_id, album_id, weeks, plays from (select track_id, album_id, count(distinct week) as weeks, cast(sum(plays) as bigint) as plays, row_number() over (partition by track_id order by count(distinct week) desc, sum(plays) desc, album_id) as n
 from {cp} group by track_id, album_id) x where n = 1""")
