"""Every operator over nulls, empties, long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from playtide.llm import decontamination, hilbert_sharding, language_id, near_dedup, packing, pii, quality_compression, quality_rules, secret_scan, substring_dedup
from playtide.llm.common import materialize


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (8, 1, 0), (9, 0, 1), (None, 1, None), (10, None, 0), (6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "one"), (3, "one")], "item_id long, text string")


def operators(labels, items, spark):
    return {
        "language": lambda d: language_id.predictions(d, language_id.fit(d)),
        "pii": lambda d: pii.scan(d, pii.train(spark, 400)),
        "decontamination": lambda d: decontamination.with_verdict(decontamination.contamination(d, items, ["doc_id"])),
        "near": lambda d: near_dedup.near_duplicates(d),
        "secrets": lambda d: secret_scan.scan(d, secret_scan.train(d)),
        "compression": lambda d: quality_compression.scores(d, quality_compression.fit(d, labels)),
        "rules": lambda d: quality_rules.judged(d, labels, d.columns),
        "sharding": lambda d: hilbert_sharding.hilbert_shards(materialize(hilbert_sharding.metadata(d)), ["lang", "source", "size"], "doc_id"),
    }


NAMES = ["language", "pii", "decontamination", "near", "secrets", "compression", "rules", "sharding"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, odd_docs, labels, items, name):
    assert operators(labels, items, spark)[name](odd_docs).count() == odd_docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd_docs, labels, items, name):
    assert operators(labels, items, spark)[name](odd_docs.limit(0)).count() == 0


def test_undetermined_languages(odd_docs):
    got = {r.doc_id: r for r in language_id.predictions(odd_docs, language_id.fit(odd_docs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))


def test_near_duplicates_of_odd_texts(odd_docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(odd_docs).collect()}
    assert got[5].component_id == got[6].component_id == got[7].component_id == 5
    assert all(got[i].component_id == i and got[i].n_shingles == 0 for i in (1, 2, 3))
    assert got[None].component_id is None and got[None].kept


def test_short_items_and_null_ids(odd_docs, items):
    got = {r["row"].doc_id: r for r in decontamination.with_verdict(decontamination.contamination(odd_docs, items, ["doc_id"])).collect()}
    assert got[4].contaminated and got[4].item_ids == ["3"]
    assert not got[1].contaminated and got[1].n_words == 0


def test_filters_keep_columns_and_rows(spark, odd_docs, labels, items):
    for f in (lambda d: quality_rules.keep_good(d, labels), near_dedup.keep_one, lambda d: decontamination.drop_contaminated(d, items), secret_scan.redact_secrets):
        out = f(odd_docs)
        assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()
    assert secret_scan.redact_secrets(odd_docs).where("doc_id = 1").first().text is None


def test_packing_of_odd_texts(odd_docs):
    p = materialize(packing.pieces(odd_docs))
    got = packing.pack(p).toPandas()
    assert len(got) == p.count()
    assert got[got.doc_id == 2].length.tolist() == [1]
    assert packing.pack(materialize(packing.pieces(odd_docs.limit(0)))).count() == 0


def test_passages_of_odd_texts(odd_docs):
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(odd_docs).collect()}
    assert set(got) == {5, 6, 7} and got[7].class_id == 5
    assert substring_dedup.repeated_passages(odd_docs.limit(0)).count() == 0


def test_slots_are_gapless(odd_docs):
    rows = hilbert_sharding.hilbert_shards(materialize(hilbert_sharding.metadata(odd_docs)), ["lang", "source", "size"], "doc_id", shards=4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert all(r.m == r.n - 1 == r.d - 1 for r in rows) and max(r.n for r in rows) - min(r.n for r in rows) <= 1
