"""One owner project of every song at every day, and album charts from song keys.

A song may stand on several projects (albums, editions, compilations).  On a day it belongs
to one of those released by then: by scope (0 before 1), then the earlier release, the larger
project, the smaller id.  The order is total, so a later release changes the owner at most
once, and the owners of a song are a short list of days.  Plays join the list as of their day;
those before the first release have no owner and count for no project.

Members without a song, a project or a release day take no part; a null scope is last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAST_SCOPE = 1 << 30


def owner_days(members: DataFrame) -> DataFrame:
    """song, owner, from_day, until_day (null: open; not included) of ``members`` (song, project, scope, released, size)."""
    sound = members.where("song is not null and project is not null and released is not null")
    claim = F.struct(F.coalesce("scope", F.lit(LAST_SCOPE)).alias("scope"), "released", (-F.coalesce("size", F.lit(0))).alias("size"), "project")
    firsts = sound.groupBy("song", "released").agg(F.min(claim).alias("claim"))  # one row a song and day
    order = Window.partitionBy("song").orderBy("released")
    held = firsts.withColumn("best", F.min("claim").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changes = held.where(F.col("best") == F.col("claim"))
    return changes.select("song", F.col("best.project").alias("owner"), F.col("released").alias("from_day"), F.lead("released").over(order).alias("until_day"))


def owned_plays(plays: DataFrame, owners: DataFrame) -> DataFrame:
    """``plays`` (song, day, ...) with the ``owner`` of their day; plays without one go."""
    o = owners.withColumnRenamed("song", "_song")
    inside = (F.col("song") == F.col("_song")) & (F.col("day") >= F.col("from_day")) & (F.col("until_day").isNull() | (F.col("day") < F.col("until_day")))
    return plays.join(o, inside).drop("_song", "from_day", "until_day")


def project_weeks(plays: DataFrame, owners: DataFrame) -> DataFrame:
    """entity (project), week, plays, ms, songs; plays (song, day, week, plays, ms) meet the owners once a song and day."""
    daily = plays.groupBy("song", "day", "week").agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms"))
    owned = owned_plays(daily, owners)
    return owned.groupBy(F.col("owner").alias("entity"), "week").agg(F.sum("plays").alias("plays"), F.sum("ms").alias("ms"), F.count_distinct("song").alias("songs"))
