"""Personal data behind a false start, and chains of overlapping candidates."""

from playtide.llm import pii


def test_behind_a_group_of_digits(spark):
    rows = [(1, "pay by card 2023 4111 1111 1111 1111 ok"), (2, "call 2024 555 123 4568 now"), (3, "order 1234-5678-9012-3457 of 12 items")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = {r.doc_id: {(s.kind, s.match, s.start) for s in r.c} for r in docs.select("doc_id", pii.candidates(docs.text).alias("c")).collect()}
    assert ("card", "4111 1111 1111 1111", 17) in proposed[1] and ("phone", "555 123 4568", 10) in proposed[2]
    found = {r.doc_id: {s.match for s in r.found} for r in pii.scan(docs, pii.train(spark)).collect()}
    assert found[1] == {"4111 1111 1111 1111"} and not found[3]


def test_a_beaten_span_beats_none(spark):
    """Of a chain of overlapping spans the first and the third stay."""
    docs = spark.createDataFrame([(1, "1111 222 3333 444 555 6666 x")], "doc_id long, text string")
    even = {"bias": 1.0, "trees": [], "cuts": dict.fromkeys(pii.KINDS, 0.0)}
    row = pii.scan(docs, even).first()
    kept = [(s.start, s.end) for s in row.found]
    every = sorted((s.start, s.end) for s in docs.select(pii.candidates(docs.text).alias("c")).first().c)
    expected = []
    for a, b in every:
        if not any(a < y and x < b for x, y in expected):
            expected.append((a, b))
    assert len(every) > len(kept) > 1 and kept == expected
