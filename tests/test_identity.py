"""Connected components and prefixes of names."""

import re

from pyspark.sql import functions as F

from playtide.operators.identity import connected, prefix_pairs


def test_long_chain_settles(spark):
    """A path in order of its nodes, whose rounds grow with the logarithm of its length."""
    n = 600
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {tuple(r) for r in connected(edges, 14).collect()} == {(i, 0) for i in range(n + 1)}


def test_prefixes_as_like_reads_them(spark):
    """Against every pair: wildcards, backslashes, empty and null names, repeated names, other brands."""
    names = ["", "a", "ab", "ab", "abc", "a%", "a%c", "_b", "\\", "\\x", "a\\", "a\\_z", "é", "éa", None]
    rows = [(i, g, n) for i, (g, n) in enumerate((g, n) for g in ("x", "y", None) for n in names)] + [(99, "x", "abcd"), (99, "z", "ab")]
    df = spark.createDataFrame(rows, "k long, g string, n string")

    def like(b, a):
        return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in a) + ".*", b, re.S)

    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] and p[1] == q[1] and None not in (p[2], q[2]) and p[0] != q[0] and len(q[2]) > len(p[2]) and like(q[2], p[2]))
    got = prefix_pairs(df, "k", "g", "n")
    assert sorted(map(tuple, got.collect())) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and prefix_pairs(df.limit(0), "k", "g", "n").count() == 0
