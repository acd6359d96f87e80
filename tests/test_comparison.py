"""Year comparisons against day sets: gaps, leap years, exports that overlap or touch."""

import random
from collections import Counter
from datetime import date, timedelta

from playtide.operators.comparison import covered, year_comparison

ZERO = date(1970, 1, 1)


def day(*ymd):
    return (date(*ymd) - ZERO).days


def before(d):
    at = ZERO + timedelta(d)
    try:
        return day(at.year - 1, at.month, at.day)
    except ValueError:
        return day(at.year - 1, 2, 28)


def brute(plays, exports):
    out = {}
    for who in {e[0] for e in exports}:
        known = {d for w, a, b in exports if w == who and a is not None and b is not None for d in range(a, b + 1)}
        counts = Counter(d for w, d in plays if w == who)
        shared = sorted(d for d in known if before(d) in known)
        for year in {(ZERO + timedelta(d)).year for d in shared}:
            own = [d for d in shared if (ZERO + timedelta(d)).year == year]
            base = {before(d) for d in own}
            # the other year's 29 February belongs to the comparison if both its neighbours do
            for d in list(base):
                if (ZERO + timedelta(d + 1)).month == 2 and (ZERO + timedelta(d + 1)).day == 29 and d + 1 in known and d + 2 in base:
                    base.add(d + 1)
            out[(who, year)] = (len(own), sum(counts[d] for d in own), sum(counts[d] for d in base), len(own) >= 90)
    return out


def test_against_day_sets(spark):
    rng = random.Random(6)
    exports, plays = [], []
    for who in range(12):
        for _ in range(rng.randint(1, 9)):
            a = day(1998, 11, 1) + rng.randrange(1200)
            exports.append((who, a, a + rng.choice([0, 5, 60, 200, 400])))
    for who, edge in ((20, [(day(1999, 1, 1), day(1999, 2, 28)), (day(2000, 1, 1), day(2000, 12, 31))]), (21, [(day(1999, 3, 1), day(1999, 12, 31)), (day(2000, 2, 29), day(2000, 4, 1))]),
                      (22, [(day(2000, 2, 29), day(2001, 12, 31))]), (23, [(day(2000, 1, 1), day(2000, 2, 28)), (day(2001, 1, 1), day(2001, 6, 1))]), (24, [(day(2000, 1, 1), day(2000, 12, 31)), (day(2001, 1, 1), day(2001, 12, 31))])):
        exports += [(who, a, b) for a, b in edge]
    plays = [(w, d) for w, a, b in exports for d in range(a, b + 1) if rng.random() < 0.4]
    exports += [(0, None, 5), (1, 9, 3), (30, None, None)]
    got = year_comparison(spark.createDataFrame(plays, "who long, day long"), spark.createDataFrame(exports, "who long, first_day long, last_day long"), "who").collect()
    assert {(r.who, r.year): (r.days, r.current, r.baseline, r.comparable) for r in got} == brute(plays, [e for e in exports if None not in e and e[1] <= e[2]])


def test_union_of_intervals(spark):
    rows = [(1, 1, 5), (1, 6, 9), (1, 2, 3), (1, 11, 12), (2, 1, 1), (None, 1, 2)]
    got = sorted(map(tuple, covered(spark.createDataFrame(rows, "who long, first_day long, last_day long"), "who").collect()))
    assert got == [(1, 1, 9), (1, 11, 12), (2, 1, 1)]


def test_leap_day_alone_has_no_counterpart(spark):
    """An export of 29 February only gives the next year no day, however its neighbours are covered."""
    exports = spark.createDataFrame([(1, day(2000, 2, 29), day(2000, 2, 29)), (1, day(2001, 1, 1), day(2001, 12, 31))], "who long, first_day long, last_day long")
    plays = spark.createDataFrame([(1, day(2000, 2, 29)), (1, day(2001, 2, 28))], "who long, day long")
    assert year_comparison(plays, exports, "who").count() == 0
