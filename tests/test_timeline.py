"""Micro-vectors of the timeline rules."""

from datetime import datetime, timedelta, timezone

import pytest

from playtide.config import PlayFilters
from playtide.operators import timeline as T

DAY = datetime(2026, 5, 27, tzinfo=timezone.utc)
SCHEMA = "play_id long, user_id long, end_us long, ms long, track_id long, album_id long, artist_id long, platform string, duration_ms long"
RULES = PlayFilters(min_ms=30_000, dynamic_threshold=False, max_gap_minutes=5)


def us(hms: str, day: datetime = DAY) -> int:
    h, m, s = map(int, hms.split(":"))
    return int((day + timedelta(hours=h, minutes=m, seconds=s)).timestamp() * 1_000_000)


def frame(spark, rows, duration=240_000, track=None):
    return spark.createDataFrame([(i, 1, e, ms, track[i] if track else 1, 1, 1, "ios", duration) for i, (e, ms) in enumerate(rows)], SCHEMA)


def test_two_full_plays_of_one_run(spark):
    r = T.runs(frame(spark, [(us("00:06:00"), 360_000), (us("00:12:00"), 360_000)], 360_000), RULES)
    assert {x.run_no for x in r.collect()} == {1}
    assert T.logical_plays(r, RULES).count() == 2


@pytest.mark.parametrize(("gap_ms", "runs"), [(300_000, 1), (300_001, 2)])
def test_idle_gap_is_inclusive(spark, gap_ms, runs):
    first = us("01:00:00")
    r = T.runs(frame(spark, [(first, 20_000), (first + (gap_ms + 20_000) * 1000, 20_000)]), RULES)
    assert max(x.run_no for x in r.collect()) == runs


def test_fragments_across_local_midnight_make_one_play_of_the_next_day(spark):
    r = T.runs(frame(spark, [(us("15:59:50"), 20_000), (us("16:00:10"), 20_000)], 40_000), RULES)
    e = T.with_calendar(T.logical_plays(r, RULES)).collect()
    assert len(e) == 1 and e[0].counted_us == us("16:00:10")
    days = {x.day: x.s for x in T.hour_slices(T.listening_intervals(r)).groupBy("day").sum("ms").toDF("day", "s").collect()}
    assert e[0].day == max(days) and sorted(days.values()) == [10_000, 30_000]


def test_one_long_row_expands(spark):
    r = T.runs(frame(spark, [(us("00:08:30"), 510_000)]), RULES)
    e = T.logical_plays(r, RULES).orderBy("ordinal").collect()
    assert [x.ms for x in e] == [240_000, 240_000, 30_000]
    assert [x.counted_us for x in e] == [us("00:04:00"), us("00:08:00"), us("00:08:30")]


def test_large_overlap_splits(spark):
    r = T.runs(frame(spark, [(us("00:10:00"), 240_000), (us("00:10:01"), 240_000)]), RULES).orderBy("end_us").collect()
    assert [x.run_no for x in r] == [1, 2] and r[1].overlap_split
    assert r[0].eff_end_us - r[0].eff_start_us == 240_000_000


def test_small_overlap_moves_forward(spark):
    r = T.runs(frame(spark, [(us("00:10:00"), 60_000), (us("00:10:59"), 60_000)]), RULES).orderBy("end_us").collect()
    assert [x.run_no for x in r] == [1, 1]
    assert r[1].eff_start_us == r[0].eff_end_us


@pytest.mark.parametrize(("ms", "plays"), [(20_000, 0), (200_000, 1)])
def test_counts_and_time_are_apart(spark, ms, plays):
    r = T.runs(frame(spark, [(us("02:00:00"), ms)], 180_000), RULES)
    assert T.effective(T.logical_plays(r, RULES), RULES).count() == plays
    assert T.listening_intervals(r).groupBy().sum("ms").first()[0] == ms


@pytest.mark.parametrize(("ms", "kept"), [(30_000, 1), (29_999, 0)])
def test_null_duration_falls_back_to_the_minimum(spark, ms, kept):
    dyn = PlayFilters(min_ms=30_000, dynamic_threshold=True)
    r = T.runs(frame(spark, [(us("02:00:00"), ms)], None), dyn)
    assert T.effective(T.logical_plays(r, dyn), dyn).count() == kept


def test_dynamic_threshold(spark):
    rows = [(us("02:00:00"), 30_000)]
    for dynamic, n in ((False, 1), (True, 0)):
        cfg = PlayFilters(min_ms=30_000, dynamic_threshold=dynamic)
        assert T.effective(T.logical_plays(T.runs(frame(spark, rows, 600_000), cfg), cfg), cfg).count() == n


def test_week_of_slices_and_counts(spark):
    wed = datetime(2026, 5, 27, tzinfo=timezone.utc)
    r = T.runs(frame(spark, [(us("15:59:50", wed), 20_000), (us("16:00:10", wed), 20_000)], 40_000), RULES)
    rows = T.weighted(T.logical_plays(r, RULES), T.week_slices(T.listening_intervals(r), 3, 0), 3, 0).groupBy("week").sum("play_count", "total_ms").toDF("week", "n", "ms").orderBy("week").collect()
    assert [(x.n, x.ms) for x in rows] == [(0, 30_000), (1, 10_000)]
    assert rows[1].week - rows[0].week == 7


def test_null_stop_times_and_empty_input(spark):
    r = T.runs(frame(spark, [(None, 20_000), (us("02:00:00"), None)]), RULES)
    assert T.listening_intervals(r).count() == 0 and T.logical_plays(r, RULES).count() == 0
    assert T.runs(frame(spark, [(1, 1)]).limit(0), RULES).count() == 0
