"""Owners of songs against a scan of the members of each play."""

import random

from playtide.operators import ownership as O


def test_against_a_scan(spark):
    rng = random.Random(8)
    projects = {p: (rng.choice([0, 1, None]), rng.choice([None, *range(0, 60, 7)]), rng.randint(1, 5)) for p in range(25)}
    members = [(rng.choice([None, *range(10)]), p, *projects[p]) for p in projects for _ in range(4)]
    plays = [(rng.randrange(11), d, d - d % 7, 1, rng.randrange(9)) for d in range(70) for _ in range(5)]
    owners = O.owner_days(spark.createDataFrame(members, "song long, project long, scope int, released long, size long"))
    df = spark.createDataFrame(plays, "song long, day long, week long, plays long, ms long")

    def owner(song, day):
        known = [(O.LAST_SCOPE if s is None else s, r, -z, p) for x, p, s, r, z in members if x == song and r is not None and r <= day]
        return min(known)[3] if known else None

    want = sorted((s, d, o) for s, d, *_ in plays if (o := owner(s, d)) is not None)
    assert sorted((r.song, r.day, r.owner) for r in O.owned_plays(df, owners).collect()) == want and 0 < len(want) < len(plays)
    totals = {}
    for s, d, w, n, ms in plays:
        if (o := owner(s, d)) is not None:
            a = totals.setdefault((o, w), [0, 0, set()])
            a[0], a[1] = a[0] + n, a[1] + ms
            a[2].add(s)
    assert {(r.entity, r.week): (r.plays, r.ms, r.songs) for r in O.project_weeks(df, owners).collect()} == {k: (a, b, len(c)) for k, (a, b, c) in totals.items()}
    assert O.owner_days(owners.limit(0).selectExpr("song", "owner as project", "0 as scope", "from_day as released", "0L as size")).count() == 0
