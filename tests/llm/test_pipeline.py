"""Every stage of the pipeline against SQL or brute force, each on its own input."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from playtide.llm import decontamination, packing, quality_rules, secret_scan
from playtide.llm.common import materialize
from tests.llm.test_oracles import secret_spans


def groups_by_brute_force(texts, k=5):
    """The smallest id of each group of texts linked by exact Jaccard similarity of 0.8."""
    sets, held = {}, defaultdict(set)
    for d, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))}
        for s in sets[d]:
            held[s].add(d)
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(texts):
        for e in set().union(*[held[s] for s in sets[d]]) if sets[d] else ():
            both = len(sets[d] & sets[e])
            if e < d and 100 * both >= 80 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d for d in texts if top(d) == d}


def test_stages(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(P.STAGES)
    assert list(stage) == ["quality_rules", "near_duplicates", "decontamination", "secrets", "packing"]
    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "") + "/*.parquet"

    def rows(sql, given):
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{path(given)}'")
        for t in ("labels", "benchmark"):
            c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        return c.execute(sql).df()

    planted = F.concat("text", F.lit(" token = 'abcdef123456' and AKIA" + "Q7" * 8 + " end"))
    given = materialize(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, planted).otherwise(F.col("text"))))
    good = materialize(stage["quality_rules"](spark, given, small))
    want = rows(quality_rules.ORACLE_SQL, given)
    assert {r.doc_id for r in good.collect()} == set(want[want.kept].doc_id)

    one = materialize(stage["near_duplicates"](spark, good, small))
    assert {r.doc_id for r in one.collect()} == groups_by_brute_force({r.doc_id: r.text for r in good.collect()})

    clean = materialize(stage["decontamination"](spark, one, small))
    want = rows(decontamination.ORACLE_SQL, one)
    assert {r.doc_id for r in clean.collect()} == set(want[~want.contaminated].doc_id)

    safe = materialize(stage["secrets"](spark, clean, small))
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (clean, safe))
    assert set(before) == set(after) and any(before[d] != after[d] for d in before)
    for d, text in before.items():
        assert not secret_spans(after[d])
        # what stands between the marks is the text as it was, and every base span is gone
        kept = after[d].split(secret_scan.MARK)
        assert re.fullmatch("(?s:.+?)".join(map(re.escape, kept)), text) if len(kept) > 1 else after[d] == text
        assert (len(kept) > 1) or not secret_spans(text)

    packed = stage["packing"](spark, safe, small).toPandas()
    encode = packing.encoder()
    for d, part in packed.sort_values("start").groupby("doc_id"):
        ids = np.append(encode(after[d]), np.uint32(packing.END_ID)).astype("<u4")
        assert part.length.sum() == len(ids) and (part.start == part.length.cumsum() - part.length).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    assert set(packed.doc_id) == set(after) and packed.groupby("sequence_id").length.sum().max() <= 1024
