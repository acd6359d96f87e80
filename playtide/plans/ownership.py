"""Projects as owners of songs: suppliers are projects, released with their first order; a song is a merged recording.

Suppliers in debt are compilations.  Plays are order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.operators import charts as C
from playtide.operators import ownership as O
from playtide.plans.base import query
from playtide.plans.charts import CHART_SQL, SIZE, frames
from playtide.plans.merging import _RECORDINGS, recording_groups
from playtide.sources.publish import scratch


def song_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, project, day, week, plays, ms, written."""
    grouped, _, _ = recording_groups(spark, sf_dir)
    keys = grouped.select(F.col("p_partkey").alias("track_id"), F.col("group_id").alias("song"))
    return scratch(frames(spark, sf_dir)["cp"].join(keys, "track_id").select("song", F.col("artist_id").alias("project"), "day", "week", "plays", "ms"))


def members(spark: SparkSession, sf_dir: str, plays: DataFrame) -> DataFrame:
    projects = plays.groupBy("project").agg(F.min("day").alias("released"), F.count_distinct("song").alias("size"))
    scope = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("project"), (F.col("s_acctbal") < 0).cast("int").alias("scope"))
    return plays.select("song", "project").distinct().join(projects, "project").join(scope, "project", "left")


_SQL = _RECORDINGS + ", " + CHART_SQL.removeprefix("with ") + """,
sp as (select grp as song, artist_id as project, day, week, plays, ms from cp join r_done on node = track_id),
pr as (select project, min(day) as released, count(distinct song) as size from sp group by project),
me as (select distinct song, project, released, size, case when s_acctbal < 0 then 1 else 0 end as scope from sp join pr using (project) join supplier on s_suppkey = project),
own as materialized (select d.song, d.day, arg_min(me.project, (me.scope, me.released, -me.size, me.project)) as owner from (select distinct song, day from sp) d join me on me.song = d.song and me.released <= d.day group by 1, 2)"""


@query("ownership_project_chart", _SQL + f"""
select entity, week, plays, ms, songs, rank from (select *, row_number() over (partition by week order by plays desc, ms desc, entity) as rank from
 (select owner as entity, week, sum(plays)::bigint as plays, sum(ms)::bigint as ms, count(distinct song) as songs from sp join own using (song, day) group by 1, 2)) where rank <= {SIZE["album"]}""")
def ownership_project_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly chart of projects by the plays of the songs that they own on the day."""
    plays = song_plays(spark, sf_dir)
    weeks = O.project_weeks(plays, O.owner_days(members(spark, sf_dir, plays)))
    return C.weekly_rankings(weeks, SIZE["album"]).select("entity", "week", "plays", "ms", "songs", "rank")


@query("ownership_songs", _SQL + " select song, arg_max(owner, day) as owner, count(distinct owner) as owners from own group by song")
def ownership_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song with the owner of its last play and the number of projects that owned a play."""
    plays = song_plays(spark, sf_dir)
    days = plays.select("song", "day").distinct()
    owned = O.owned_plays(days, O.owner_days(members(spark, sf_dir, plays)))
    return owned.groupBy("song").agg(F.max_by("owner", "day").alias("owner"), F.count_distinct("owner").alias("owners"))
