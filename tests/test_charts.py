"""Chart vectors."""

from playtide.operators import charts as C

W = "entity long, week long, rank long, plays long, ms long"


def test_running_metrics(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, 1), (1, 7, 3, 1, 1), (1, 14, 3, 1, 1)], W)
    rows = C.running_metrics(df).orderBy("week").collect()
    assert [(r.running_peak, r.running_wks, r.running_peak_wks) for r in rows] == [(5, 1, 1), (3, 2, 1), (3, 3, 2)]


def test_streak_takes_the_first_longest(spark):
    df = spark.createDataFrame([(1, w, 1, 1, 1) for w in (3, 10, 31)], W)
    r = C.streaks(df).collect()
    assert [(x.length, x.start_week, x.end_week) for x in r] == [(2, 3, 10)]


def test_power_score(spark):
    df = spark.createDataFrame([(1, 0, 1, 100, 0), (1, 7, 2, 60, 0), (2, 0, 2, 50, 0), (2, 7, 1, 80, 0)], W)
    r = {x.entity: x for x in C.power_scores(df, "track").collect()}
    assert (r[1].power, r[1].peak, r[1].weeks, r[1].weeks_at_peak, r[1].power_rank) == (790, 1, 2, 1, 1)


def test_changes(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, 1), (1, 7, 3, 1, 1), (1, 21, 3, 1, 1), (1, 28, 4, 1, 1), (1, 35, 4, 1, 1)], W)
    assert [r.change for r in C.change_column(df).orderBy("week").collect()] == ["NEW", "up 2", "RE", "down 1", "same"]


def test_ties_go_to_time_then_id(spark):
    df = spark.createDataFrame([(3, 0, 5, 10), (1, 0, 5, 10), (2, 0, 5, 20)], "entity long, week long, plays long, ms long")
    assert [r.entity for r in C.weekly_rankings(df, 2).orderBy("rank").collect()] == [2, 1]
