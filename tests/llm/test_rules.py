"""Cutoffs of the quality rules: chosen where labels allow, with the promised false rejection."""

import random

from playtide.llm import quality_rules as Q


def test_false_rejection_is_controlled(spark):
    """Sixty strata drawn from one distribution: the true rejection of a chosen cutoff exceeds the risk in none."""
    rng = random.Random(8)
    draw = lambda: rng.betavariate(2, 30)
    good = spark.createDataFrame([(f"s{k}", draw(), 0.0) for k in range(60) for _ in range(1500)], "stratum string, a double, b double")
    chosen = Q.select_cutoffs(good, "stratum", ["a", "b"], risk=0.05, delta=0.05).collect()
    assert {r.rule for r in chosen} == {"a", "b"} and len(chosen) == 120
    pool = [draw() for _ in range(200_000)]
    true = {c: sum(v > c for v in pool) / len(pool) for c in {r.cutoff for r in chosen if r.rule == "a"}}
    assert all(true[r.cutoff] <= 0.025 for r in chosen if r.rule == "a")
    # not needlessly lenient: some cutoff rejects, and a rule without any value rejects from its lowest cutoff
    assert max(true.values()) > 0.002 and {r.cutoff for r in chosen if r.rule == "b"} == {min(Q.CUTOFFS)}


def test_few_labels_prove_nothing(spark):
    good = spark.createDataFrame([("s", 0.0)] * 20, "stratum string, a double")
    assert Q.select_cutoffs(good, "stratum", ["a"]).count() == 0


def test_a_cutoff_takes_effect(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(60)), "en") for k in range(900)] + [(1000, " ".join("#" * 6 + word() for _ in range(60)), "en"), (1001, " ".join("#" * 6 + word() for _ in range(60)), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(900)], "doc_id long, quality int")
    got = {r.row.doc_id: r for r in Q.judged(docs, labels, ["doc_id"]).collect()}
    assert not got[1000].kept and got[1000].rejected_by == "r_symbols"
    assert got[1001].kept and sum(got[k].kept for k in range(900)) >= 0.95 * 900
