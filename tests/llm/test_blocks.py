"""A benchmark read in several blocks gives the rows of one block."""

from playtide.llm import decontamination as D


def test_blocks_agree(spark, small, tiny_docs):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    key = lambda n: sorted((r["row"].doc_id, r.n_words, r.n_hit, r.contaminated, tuple(r.item_ids)) for r in D.with_verdict(D.contamination(tiny_docs, items, ["doc_id"], index_words=n)).collect())
    words = sum(len(r.text) // 2 + 1 for r in items.collect())
    one = key(10**9)
    assert any(r[3] for r in one) and key(words // 3) == one
