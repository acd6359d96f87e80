"""Several artists a track: effective credits, fan-out, and collaborations.

``credits`` names who is credited (track_id, artist_id, role), in raw, automatic and manual
rows; ``aliases`` maps an artist to its canonical one (artist_id, canonical_id).  A fanned-out
figure counts an event once for each credited artist; shares keep the events as denominator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical(frame: DataFrame, aliases: DataFrame, *event_key: str) -> DataFrame:
    """``frame`` with the canonical artist_id; with ``event_key`` one row for each of its values and artist."""
    to = aliases.select(F.col("artist_id").alias("_alias"), "canonical_id")
    named = frame.join(to, F.col("artist_id") == F.col("_alias"), "left").withColumn("artist_id", F.coalesce("canonical_id", "artist_id")).drop("_alias", "canonical_id")
    return named.dropDuplicates([*event_key, "artist_id"]) if event_key else named


def effective_credits(credits: DataFrame, aliases: DataFrame) -> DataFrame:
    """track_id, artist_id, role, position: one row a track and canonical artist, primary if any of its rows is, primaries first."""
    one = canonical(credits, aliases).groupBy("track_id", "artist_id").agg(F.max(F.col("role") == "primary").alias("lead"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("lead"), "artist_id")).cast("long")
    return one.select("track_id", "artist_id", F.when(F.col("lead"), "primary").otherwise("featured").alias("role"), place.alias("position"))


def labels(effective: DataFrame) -> DataFrame:
    """track_id, primary_artist (the first) and label (all, in order)."""
    listed = F.sort_array(F.collect_list(F.struct("position", "artist_id")))
    return effective.groupBy("track_id").agg(listed.alias("l")).select(
        "track_id", F.element_at("l.artist_id", 1).alias("primary_artist"), F.concat_ws(", ", F.transform("l.artist_id", lambda a: a.cast("string"))).alias("label")
    )


def fan_out(events: DataFrame, effective: DataFrame) -> DataFrame:
    """One row for each event and credited artist; uncredited events go."""
    return events.drop("artist_id").join(effective.select("track_id", "artist_id", "role"), "track_id")


def artist_shares(events: DataFrame, slices: DataFrame, effective: DataFrame) -> DataFrame:
    """artist_id, plays, total_ms, play_share, time_share; shares of several artists may add up to more than one."""
    plays = fan_out(events, effective).groupBy("artist_id").agg(F.count(F.lit(1)).alias("plays"))
    time = fan_out(slices, effective).groupBy("artist_id").agg(F.sum("ms").alias("total_ms"))
    whole = events.agg(F.count(F.lit(1)).alias("all_plays")).crossJoin(slices.agg(F.sum("ms").alias("all_ms")))
    both = plays.join(time, "artist_id", "full_outer").crossJoin(F.broadcast(whole))
    n, t = F.coalesce("plays", F.lit(0)), F.coalesce("total_ms", F.lit(0))
    return both.select("artist_id", n.alias("plays"), t.cast("long").alias("total_ms"), F.round(n / F.col("all_plays"), 6).alias("play_share"), F.round(t / F.col("all_ms"), 6).alias("time_share"))


def collaborations(frame: DataFrame, effective: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose track has two canonical artists or more."""
    several = effective.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return frame.join(several, "track_id", "left_semi")


def collaboration_ranking(events: DataFrame, slices: DataFrame, effective: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """entity_id, plays, total_ms, place of the collaborations by ``entity``; artists are all participants, whatever their role."""
    both = [collaborations(x, effective) for x in (events, slices)]
    if entity == "artist_id":
        both = [fan_out(x, effective) for x in both]
    plays = both[0].groupBy(F.col(entity).alias("entity_id")).agg(F.count_distinct("event_id").alias("plays"))
    time = both[1].groupBy(F.col(entity).alias("entity_id")).agg(F.sum("ms").cast("long").alias("total_ms"))
    order = [F.desc("plays"), F.desc("total_ms"), F.asc("entity_id")]
    top = plays.join(time, "entity_id", "left").withColumn("total_ms", F.coalesce("total_ms", F.lit(0))).orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
