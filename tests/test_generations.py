"""Generations, the weekly ledger and the delta index: equal to rebuilds, untouched files untouched, old readers safe."""

import glob
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from playtide.config import ChartConfig
from playtide.operators import ledger as L
from playtide.operators import maintenance as M
from playtide.operators import search as S
from playtide.operators.charts import weekly_totals
from playtide.sources import generations as G

US_WEEK = 7 * 86_400_000_000
PLAYS = "end_us long, track_id long, album_id long, artist_id long, plays long, ms long"


@pytest.fixture
def root(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/gen-{uuid.uuid4().hex}"


def files(root):
    path = root.removeprefix("file://")
    return {f[len(path) :]: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def played(rng, weeks, n=40):
    return [(w * US_WEEK + rng.randrange(US_WEEK), rng.randrange(9), rng.randrange(4), rng.randrange(3), 1, rng.randrange(1000)) for w in weeks for _ in range(n)]


def test_ledger_follows_its_plays(spark, root, monkeypatch):
    rng, cfg = random.Random(1), ChartConfig()
    first = played(rng, range(100, 106))
    old, new = spark.createDataFrame(first, PLAYS), spark.createDataFrame(first[5:] + played(rng, [106], 7), PLAYS)
    one = L.refresh(spark, root, old, cfg, weeks_a_part=1)
    before = files(root)
    assert L.refresh(spark, root, old, ChartConfig(top_n=5), weeks_a_part=1) == one and files(root) == before  # a rerun writes nothing
    weeks = L.changed_weeks(old, new, cfg)
    two = L.refresh(spark, root, new, cfg, weeks, 1)
    after = files(root)
    changed = {str(r.week) for r in weeks.collect()}
    assert 0 < len(changed) < 6
    assert {k: v for k, v in after.items() if k in before} == before
    assert {k.split("_part=")[1].split("/")[0] for k in after.keys() - before.keys()} == {str(int(w) // 7) for w in changed}
    same = lambda a, b: sorted(map(tuple, a.select("entity", "week", "plays", "ms").collect())) == sorted(map(tuple, b.select("entity", "week", "plays", "ms").collect()))
    for k in L.KINDS:
        assert same(two.read(spark, k), weekly_totals(new, f"{k}_id", cfg)) and same(one.read(spark, k), weekly_totals(old, f"{k}_id", cfg))
    # the ledger serves its own plays; other plays and other rules come from the raw rows
    asked = []
    monkeypatch.setattr(L, "weekly_totals", lambda *a: asked.append(1) or weekly_totals(*a))
    assert same(L.weekly(spark, root, new, "track", cfg, 1), weekly_totals(new, "track_id", cfg)) and not asked
    assert same(L.weekly(spark, root, old, "track", cfg, 1), weekly_totals(old, "track_id", cfg)) and len(asked) == 1
    shifted = ChartConfig(week_start_dow=3)
    assert same(L.weekly(spark, root, new, "track", shifted), weekly_totals(new, "track_id", shifted)) and len(asked) == 2
    three = L.refresh(spark, root, new, shifted, weeks)  # stale rules: all weeks
    assert same(three.read(spark, "artist"), weekly_totals(new, "artist_id", shifted))


def test_a_shadow_that_fails_is_never_seen(spark, root):
    rng, cfg = random.Random(2), ChartConfig()
    first = played(rng, range(100, 103))
    old, new = spark.createDataFrame(first, PLAYS), spark.createDataFrame(first + played(rng, [103, 104], 3), PLAYS)
    one = L.refresh(spark, root, old, cfg, weeks_a_part=1)
    with pytest.raises(G.InvalidGeneration):  # a week is missing from the changed ones
        L.refresh(spark, root, new, cfg, L.changed_weeks(old, new, cfg).limit(1), 1)
    assert G.current(spark, root) == one
    assert L.refresh(spark, root, new, cfg, L.changed_weeks(old, new, cfg), 1).number == 2


def test_no_generation_and_no_rows(spark, root):
    assert G.current(spark, root) is None
    none = spark.createDataFrame([], PLAYS)
    L.refresh(spark, root, none, ChartConfig())
    assert L.weekly(spark, root, none, "album", ChartConfig()).count() == 0


DOCS = "entity long, kind string, label string, secondary string, alias string, popularity long"


def test_three_imports_equal_a_rebuild(spark, root):
    rng = random.Random(3)
    name = lambda: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(2))
    rows = {i: (i, "track", name(), name(), None, i) for i in range(300)}
    now = M.publish_index(spark, root, spark.createDataFrame(list(rows.values()), DOCS), "0")
    for step, (changed, deleted) in enumerate([({7: "new words", 301: "red ring"}, {8, 999}), ({}, set()), ({301: "blue ring"}, {7, 301} - {301})]):
        before = files(root)
        for i, label in changed.items():
            rows[i] = (i, "album", label, "x", "y", 1)
        for i in deleted - set(changed):
            rows.pop(i, None)
        edit = spark.createDataFrame([rows[i] for i in changed], DOCS)
        now = M.apply_delta(spark, now, edit, spark.createDataFrame([(i,) for i in deleted], "entity long"), str(step + 1))
        built, kept = S.build_index(spark.createDataFrame(list(rows.values()), DOCS)), M.read_index(spark, now)
        for a, b in ((built.entities, kept.entities), (built.postings, kept.postings), (built.counts, kept.counts)):
            assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
        after = files(root)
        assert {k: v for k, v in after.items() if k in before} == before
        shards = {k.split("_part=")[1].split("/")[0] for k in after.keys() - before.keys() if k.startswith("/postings/")}
        assert len(shards) <= len(changed) + len(deleted) and (changed or deleted or not after.keys() - before.keys())
        assert set(kept.entities.select(F.col("entity")).toPandas()["entity"]) == set(rows)
