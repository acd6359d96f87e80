"""Ranks, records over all weeks and records of one artist on several charts on small frames."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.operators.ranking import ranked_by
from playtide.plans import record_scans as R


def test_rank_with_ties(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([1, 5, 5, 9, 40])) for i in range(200)] + [(999, None)], "i long, v long")
    want = {r.i: r.n for r in df.where("v is not null").select("i", F.rank().over(Window.orderBy(F.desc("v"))).alias("n")).collect()}
    assert {r.i: r.place for r in ranked_by(df, "place", "v").collect()} == want | {999: None}


def test_double_debut_and_triple(spark, monkeypatch):
    weekly = lambda rows: spark.createDataFrame(rows, "entity long, week long, rank long, plays long, ms long")
    track, album, artist = weekly([(1, 7, 1, 5, 0), (2, 7, 2, 3, 0), (2, 14, 1, 3, 0)]), weekly([(10, 7, 1, 5, 0), (10, 14, 1, 5, 0)]), weekly([(100, 7, 1, 5, 0), (101, 14, 1, 5, 0)])
    cp = spark.createDataFrame([(1, 10, 100, 9, 7), (1, 10, 101, 2, 7), (2, 10, 101, 3, 14), (2, 11, 100, 3, 14)], "track_id long, album_id long, artist_id long, plays long, week long")
    first = lambda rows: spark.createDataFrame(rows, "entity long, first_week long, debut_no1 boolean")
    held = {"cp": cp, "w_track": track, "w_album": album, "w_artist": artist, "sum_track": first([(1, 7, True), (2, 7, False)]), "sum_album": first([(10, 7, True)])}
    monkeypatch.setattr(R, "frames", lambda s, d: held)
    assert [tuple(r) for r in R.record_double_debut(spark, "").collect()] == [(7, 100, 1, 10)]
    # in the second week another artist leads than the one who made the leading album
    assert [tuple(r) for r in R.record_triple_no1(spark, "").collect()] == [(7, 100, 1, 10)]
