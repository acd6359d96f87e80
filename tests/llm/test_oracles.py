"""Queries with SQL against DuckDB, the others against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from playtide.llm import near_dedup, packing, pii, queries, quality_rules, secret_scan, substring_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    plain = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    canonical = lambda df: df[sorted(df.columns)].map(plain).sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(canonical(queries.QUERIES[name](spark, small).toPandas()), canonical(c.execute(queries.ORACLE_SQL[name]).df()))


def digest(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d(m)) <= 19 and luhn(d(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(d(m)) <= 15),
    ]
    return [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m)]


def secret_spans(t):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    rules = [("(" + word + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m)]


TRICKY = [
    (101, "a.b@c.d_e@f.g x@y z@q.r.s. 1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1"), (102, "12 4111 1111 1111 1111 and 4111-1111-1111-1111"), (103, "é+1 (988) 555-2485é 漢+12 34567890+1"),
    (104, "token==abcdef PassWord : 'hunter2' api_key=short apikey=longenough"), (105, "AKIA" + "A" * 16 + "AKIA0 " + "ab12" * 8 + "g"), (106, None), (107, "@" * 50 + "a@b.c." + "1" * 3000 + ".2"),
]


@pytest.mark.parametrize(("op", "names", "brute"), [(pii, pii.KINDS, pii_spans), (secret_scan, ["assign", "access", "hex"], secret_spans)])
def test_base_spans(spark, tiny_docs, op, names, brute):
    docs = tiny_docs.select("doc_id", "text").union(spark.createDataFrame(TRICKY, "doc_id long, text string"))
    model = pii.train(spark, 600) if op is pii else secret_scan.train(tiny_docs)
    for r in op.scan(docs, model).collect():
        mine = [(s.start, s.rank, s.end) for s in r.base]
        assert digest(mine, names) == digest(brute(r.text), names)
        assert set(mine) <= {(s.start, s.rank, s.end) for s in r.found}


def test_added_spans(spark):
    docs = spark.createDataFrame([(1, "call (555) 123-4567 or mail bob.lee [at] mail [dot] com, card 12 4111 1111 1111 1111"), (2, "order 1234-5678-9012-3457 of 12 items"), (3, "x 9fKq2LmZx81PqRt7VbN0 userNameFilePathIndex")], "doc_id long, text string")
    found = {r.doc_id: {s.match for s in r.found} for r in pii.scan(docs, pii.train(spark)).collect()}
    assert found[1] == {"(555) 123-4567", "bob.lee [at] mail [dot] com", "4111 1111 1111 1111"} and not found[2]
    secrets = {r.doc_id: {s.match for s in r.found} for r in secret_scan.scan(docs, secret_scan.train(docs)).collect()}
    assert secrets[3] == {"9fKq2LmZx81PqRt7VbN0"} and not secrets[2]


def test_packing_round_trip(spark, small, tiny_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.op8_packing(spark, small).toPandas()
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in tiny_docs.collect()}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert got.length.sum() == sum(map(len, ids.values()))
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 1024
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in total)
    assert padding <= 0.01 * total.sum() + 1024


def test_patterns_use_every_piece():
    rng = np.random.default_rng(3)
    h = {int(k): int(n) for k, n in zip(range(32, 1025, 32), rng.poisson(300, 32), strict=True)} | {k: int(rng.poisson(300)) for k in range(1, 32)}
    used = defaultdict(int)
    plan = packing.patterns_for(h)
    for pattern, times in plan:
        assert sum(s * a for s, a in pattern.items()) <= 1024
        for s, a in pattern.items():
            used[s] += a * times
    assert dict(used) == {k: n for k, n in h.items() if n}
    assert sum(t for _, t in plan) * 1024 <= 1.01 * sum(k * n for k, n in h.items())


def test_repeated_passages(spark, tiny_docs):
    at = defaultdict(set)
    for r in tiny_docs.collect():
        w = r.text.lower().split()
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add(r.doc_id)
    expected = set().union(*[v for v in at.values() if len(v) > 1])
    got = {r.doc_id for r in substring_dedup.repeated_passages(tiny_docs).collect()}
    assert expected <= got


def test_block_tasks_find_the_same_groups(spark, tiny_docs):
    key = lambda df: sorted((r.doc_id, r.component_id) for r in df.collect())
    assert key(near_dedup.near_duplicates(tiny_docs)) == key(near_dedup.near_duplicates(tiny_docs, block=2))


def test_binomial_tail(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (5, 50, 400) for k in (0, 1, 3) if k < n], "n long, k long")
    for r in df.select("n", "k", quality_rules.binomial_tail(df.n, df.k, 0.1).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.1**i * 0.9 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact if r.k < r.n * 0.1 else 1.0, rel=1e-9)


def test_held_out_accuracy(spark, small, tiny_docs):
    lang = {r.doc_id: r.lang for r in tiny_docs.collect()}
    got = [r for r in queries.QUERIES["op1_language_id"](spark, small).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rated = [r for r in queries.QUERIES["op6_quality_compression"](spark, small).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in rated) >= 0.8 * len(rated)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P
    from playtide.llm.common import materialize

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = P.run(spark, small).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.collect()}
    assert not any(secret_spans(r.text) for r in docs.collect())
