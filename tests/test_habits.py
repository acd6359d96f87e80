"""Credits, periods and habit records against small vectors."""

import pytest
from pyspark.sql import functions as F

from playtide.operators import credits as A
from playtide.operators import habits as H
from playtide.operators import periods as P


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def effective(spark):
    raw = spark.createDataFrame([(1, 7, "featured"), (1, 5, "primary"), (1, 9, "featured"), (2, 9, "featured")], "track_id long, artist_id long, role string")
    return A.effective_credits(raw, spark.createDataFrame([(9, 5)], "artist_id long, canonical_id long"))


def test_one_play_two_credits(spark, effective):
    assert rows(effective) == [(1, 5, "primary", 1), (1, 7, "featured", 2), (2, 5, "featured", 1)]
    e = spark.createDataFrame([("a", 1, 0, 100), ("b", 2, 0, 50), ("c", 3, 0, 25)], "event_id string, track_id long, artist_id long, ms long")
    fanned = A.fan_out(e, effective)
    assert rows(fanned.select("event_id", "artist_id", "role")) == [("a", 5, "primary"), ("a", 7, "featured"), ("b", 5, "featured")]
    assert rows(A.labels(effective)) == [(1, 5, "5, 7"), (2, 5, "5")]
    # three events are the denominator, though two artists share one of them
    assert rows(A.artist_shares(e, e, effective)) == [(5, 2, 150, 0.666667, 0.857143), (7, 1, 100, 0.333333, 0.571429)]
    assert rows(A.collaborations(e, effective).select("event_id")) == [("a",)]
    assert rows(A.collaboration_ranking(e, e, effective, "artist_id")) == [(5, 1, 100, 1), (7, 1, 100, 2)]


@pytest.mark.parametrize(("period", "first", "last"), [("last_4_weeks", 19697, 19724), ("last_6_months", 19542, 19724), ("today", 19730, 19730), ("this_week", 19730, 19730), ("this_year", 19723, 19730), ("lifetime", 19000, 19724), ("other", 19000, 19724), ("custom", 3, None)])
def test_periods(spark, period, first, last):
    """Day 19730 is Monday, 8 January 2024; the latest data are of 2 January."""
    e = spark.createDataFrame([(19000,), (19724,)], "day long")
    got = P.bounds(e, period, F.lit(19730).cast("long"), 3, None).first()
    assert tuple(got) == (first, last)


def test_slices_keep_their_own_day(spark):
    span = spark.createDataFrame([(10, 10)], "first_day long, last_day long")
    s = spark.createDataFrame([(9, 30_000), (10, 10_000)], "day long, ms long")
    assert rows(P.within(s, span)) == [(10, 10_000)]


def test_a_repeat_starts_a_run_of_its_own(spark):
    """1 2 3 2 3 4 5: 1 2 3, then 2 3 4 5; a sliding window would not differ here, 1 2 1 3 does."""
    e = [(1, k, f"{k}", x) for k, x in enumerate([1, 2, 3, 2, 3, 4, 5])] + [(2, k, f"{k}", x) for k, x in enumerate([1, 2, 1, 3])] + [(3, 0, "0", 8)]
    df = spark.createDataFrame(e, "user_id long, counted_us long, event_id string, track_id long")
    assert rows(H.no_repeat_runs(df, "track_id")) == [(1, 4), (2, 2), (3, 1)]
    assert H.no_repeat_runs(df.limit(0), "track_id").count() == 0


@pytest.mark.parametrize(("total", "targets"), [(499, []), (1700, [500, 1000, 1500]), (3000, [1000, 2000, 3000]), (6500, [1000, 2000, 5000, 6000]), (10_000, [1000, 2000, 5000, 8000, 10_000]), (45_000, [1000, 5000, 10_000, 20_000, 30_000, 40_000])])
def test_milestone_ladder(total, targets):
    assert H.milestone_targets(total) == targets


def test_nth_rows_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at"))
    assert rows(H.nth_rows(df, ["at"], [1, 2, 500, 1000])) == [(0, 1), (1, 2), (499, 500), (999, 1000)]
    assert H.nth_rows(df, ["at"], []).count() == 0 and H.nth_rows(df.limit(0), ["at"], [1]).count() == 0


def test_silences_and_nights(spark):
    days = spark.createDataFrame([(1, 0), (1, 7), (1, 14), (1, 15), (2, 0), (2, 6)], "track_id long, day long")
    assert rows(H.comeback(days, "track_id")) == [(1, 7, 7)]
    e = spark.createDataFrame([(19722, 20, 1, 1), (19722, 19, 1, 1), (19723, 4, 2, 1), (19723, 0, 2, 2), (19723, 5, 2, 2)], "day long, hour long, track_id long, artist_id long")
    assert rows(H.new_year(e)) == [(2024, 3, 2, 1)]


def test_rested_and_shares(spark):
    e = spark.createDataFrame([(1, 0, True)] * 10 + [(2, 0, False)] * 9 + [(3, 91, True)] * 12 + [(4, 1, False)] * 11, "track_id long, day long, forwarded boolean")
    assert [r.track_id for r in H.rediscovery(e, "track_id").collect()] == [1]
    assert [tuple(r) for r in H.share_of(e, "track_id", "forwarded", 10, F.desc("plays")).collect()] == [(3, 12, 12, 100.0), (1, 10, 10, 100.0), (4, 11, 0, 0.0)]


def test_personality_and_age(spark):
    s = spark.createDataFrame([(1, 5.0, 9.0, 1.0), (2, 7.0, 7.0, 1.0), (3, 0.0, 0.0, 3.0)], "user_id long, a double, b double, c double")
    got = H.resolve_personality(s, ["a", "b", "c"], {("b", "a"): "both"}, {"a": "only a"}, "other")
    assert rows(got.select("user_id", "primary", "label")) == [(1, "b", "both"), (2, "a", "only a"), (3, "c", "other")]
    e = spark.createDataFrame([(1, 2020, 1), (1, 2020, 1), (1, 2020, 2), (1, 2020, 3)], "user_id long, year long, track_id long")
    r = spark.createDataFrame([(1, 2020), (2, 2011), (3, None)], "track_id long, release_year long")
    assert rows(H.listening_age(e, r, ["user_id"])) == [(1, 2020, 2016, 4)]
    assert rows(H.trend_chaser(e, r, ["user_id"])) == [(1, 2020, 100.0)]
