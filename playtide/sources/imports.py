"""Exports of a streaming account as tables: history, library, playlists, searches.

Files are JSON arrays (``multiLine``), one task a file; a malformed file fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a history record.
HISTORY = "ts string, platform string, ms_played long, conn_country string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, reason_start string, reason_end string, shuffle boolean"
LIBRARY = "tracks array<struct<artist:string,album:string,track:string,uri:string>>, albums array<struct<artist:string,album:string,uri:string>>, artists array<struct<name:string,uri:string>>"
PLAYLISTS = "playlists array<struct<name:string,lastModifiedDate:string,items:array<struct<track:struct<trackName:string,artistName:string,albumName:string,trackUri:string>,addedDate:string>>>>"
SEARCHES = "platform string, searchTime string, searchQuery string, searchInteractionURIs array<string>"


def _json(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def record_fingerprint(df: DataFrame, fields: list[str]) -> Column:
    """SHA-256 of the record's JSON with its fields in order of name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def streaming_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of history files without exact repeats, with fingerprint, source file and stop time."""
    raw = _json(spark, HISTORY, path)
    fields = raw.columns
    keyed = raw.select("*", F.col("_metadata.file_path").alias("source_file"), record_fingerprint(raw, fields).alias("fingerprint"))
    once = keyed.groupBy("fingerprint").agg(F.min("source_file").alias("source_file"), *[F.first(c).alias(c) for c in fields])
    return once.withColumn("end_us", F.unix_micros(F.try_to_timestamp(F.col("ts"))))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """source_file, records, first and last time of the history files."""
    raw = _json(spark, HISTORY, path).select("ts", F.col("_metadata.file_path").alias("source_file"))
    return raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file; equal digests are repeated files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Saved tracks, albums and artists."""
    raw = _json(spark, LIBRARY, path)
    return {k: raw.select(F.inline(k)) for k in ("tracks", "albums", "artists")}


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """One row per playlist entry with its place; an empty playlist keeps one row without entry."""
    p = _json(spark, PLAYLISTS, path).select(F.inline("playlists"))
    return p.select("name", "lastModifiedDate", F.posexplode_outer("items").alias("position", "item")).select("name", "lastModifiedDate", "position", "item.track.*", "item.addedDate")


def searches(spark: SparkSession, path: str) -> DataFrame:
    """Search history with UTC time; rows that repeat query, time and platform are one."""
    raw = _json(spark, SEARCHES, path)
    at = F.try_to_timestamp(F.regexp_replace("searchTime", r"\[UTC\]$", ""))
    return raw.select("platform", F.lower(F.trim("searchQuery")).alias("query"), at.alias("at"), "searchInteractionURIs").where("at is not null").dropDuplicates(["platform", "query", "at"])


def classify_inference(text: Column) -> Column:
    """Keyword rules of advertising tags."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("^1p_"), "first party").when(low.rlike("^3p_"), "third party").when(low.rlike("demographic|age|gender"), "demographic").otherwise("interest")
