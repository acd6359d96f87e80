"""Import changes, champions by album and decade, and platform classes; the SQL is written apart from the DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.config import LOCAL_SHIFT_US, US_PER_DAY
from playtide.functions.text import platform_class
from playtide.operators import changes as X
from playtide.operators import charts as C
from playtide.plans.base import query
from playtide.plans.charts import CHART_SQL, _score_sql, frames, weekly
from playtide.plans.timeline import TIMELINE_SQL, run_rows
from playtide.sources.plays import RAW_PLAYS_SQL, raw_plays

# two exports of the plays: the old one ends before the last local day, the new one starts behind the first
_DAY = f"(end_us + {LOCAL_SHIFT_US}) // {US_PER_DAY}"
_SNAPSHOTS = f"""old_rows as (select * from raw_plays where {_DAY} < (select max({_DAY}) from raw_plays)),
new_rows as (select * from raw_plays where {_DAY} > (select min({_DAY}) from raw_plays)),
diff as (select coalesce(o.play_id, n.play_id) as play_id, o.end_us as old_at, n.end_us as new_at from old_rows o full join new_rows n on o.play_id = n.play_id)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    day = F.floor((F.col("end_us") + LOCAL_SHIFT_US) / US_PER_DAY).cast("long")
    rows = raw_plays(spark, sf_dir).withColumn("day", day)
    ends = F.broadcast(rows.agg(F.min("day").alias("first"), F.max("day").alias("last")))
    placed = rows.crossJoin(ends)
    return placed.where("day < last"), placed.where("day > first")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.difference(*snapshots(spark, sf_dir), "play_id", "end_us")


query("change_closure", TIMELINE_SQL + f",\n{_SNAPSHOTS}" + """,
hit as (select distinct user_id, run_no from run_rows where play_id in (select play_id from diff where old_at is distinct from new_at))
select r.play_id, r.user_id, r.run_no from run_rows r join hit using (user_id, run_no)""")(
    lambda s, d: X.closure(run_rows(s, d), X.changed_keys(diff(s, d), "play_id")).select("play_id", "user_id", "run_no")
)
query("change_import_plan", f"with {RAW_PLAYS_SQL},\n{_SNAPSHOTS}" + """,
c as (select count(*) filter (where old_at is null) as added, count(*) filter (where new_at is null) as removed, count(old_at + new_at) as unchanged,
  min(new_at) filter (where old_at is null) as first_new, max(old_at) as last_old from diff)
select added, removed, unchanged, case when added + removed = 0 then 'identical' when removed = 0 then case when first_new >= last_old then 'tail' else 'superset' end
  when added = 0 then 'subset' when unchanged = 0 then 'disjoint' else 'mixed' end as relation from c""")(
    lambda s, d: X.relation(diff(s, d))
)
query("change_range_covered", f"with {RAW_PLAYS_SQL},\n{_SNAPSHOTS}" + """
select *, new_first <= old_first and new_last >= old_last as covers from (select min(end_us) as old_first, max(end_us) as old_last from old_rows), (select min(end_us) as new_first, max(end_us) as new_last from new_rows)""")(
    lambda s, d: X.covers(*snapshots(s, d), "end_us")
)


def _album_artists(f: dict[str, DataFrame]) -> DataFrame:
    return f["cp"].select("album_id", "artist_id").distinct()


def artist_most_no1_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    first = f["w_album"].where("rank = 1").select(F.col("entity").alias("album_id"), "week")
    won = first.join(_album_artists(f), "album_id").groupBy("artist_id").agg(F.count_distinct("album_id").alias("no1_albums"), F.count(F.lit(1)).alias("no1_album_weeks"))
    return won.orderBy(F.desc("no1_albums"), F.desc("no1_album_weeks"), "artist_id").limit(15)


query("record_artist_most_no1_album", CHART_SQL + """ select artist_id, count(distinct entity) as no1_albums, count(*) as no1_album_weeks
from w_album join (select distinct album_id, artist_id from cp) on entity = album_id where rank = 1 group by artist_id order by 2 desc, 3 desc, 1 limit 15""")(artist_most_no1_album)  # fmt: skip


def self_replacement_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    people = _album_artists(f)
    return C.replaced_leaders(f["w_album"], people.withColumnRenamed("album_id", "entity"))


query("record_self_replacement_album", CHART_SQL + """, p as (select distinct album_id, artist_id from cp),
f as (select week, entity from w_album where rank = 1),
x as (select n.week, n.entity, (select max_by(o.entity, o.week) from f o where o.week < n.week and o.week >= n.week - 8) as prev_entity from f n)
select week, prev_entity, entity, count(*) as shared_artists from x join p a on a.album_id = entity join p b on b.album_id = prev_entity and a.artist_id = b.artist_id
where entity <> prev_entity group by all""")(self_replacement_album)  # fmt: skip


def decade_best(spark: SparkSession, sf_dir: str, kind: str = "track") -> DataFrame:
    w = weekly(kind)(spark, sf_dir)
    first = w.groupBy("entity").agg(F.min("week").alias("first_week"))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("first_week").cast("int")))
    return C.best_of_decade(C.power_scores(w, kind), first.select("entity", (F.floor(year / 10) * 10).cast("long").alias("decade")))


query("record_decade_best_track", CHART_SQL + _score_sql("track") + """ select * from (select decade, entity, power, weeks, peak, row_number() over (partition by decade order by power desc, weeks desc, peak, entity) as place
from scores join (select entity, year(date '1970-01-01' + first_week::int) // 10 * 10 as decade from sum_track) using (entity)) where place <= 5""")(decade_best)  # fmt: skip

query("platform_classes", """select platform, count(*) as pages from (select case when html is null or html = '' then 'unknown' when contains(lower(html), 'ios') then 'ios' when regexp_matches(lower(html), 'osx|mac') then 'osx'
  when contains(lower(html), 'win') then 'windows' when contains(lower(html), 'android') then 'android' when regexp_matches(lower(html), 'web|browser') then 'web' else 'other' end as platform from pages) group by platform""")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").groupBy(platform_class(F.col("html")).alias("platform")).agg(F.count(F.lit(1)).alias("pages"))
)
