"""MinHash near-deduplication with tensored banding and exact verification.

Every distinct shingle set gets ``2 * HALVES`` half keys, each of ``ROWS`` minhashes,
in two collections.  A table key is a pair (half key of the first collection, half
key of the second), so ``HALVES**2`` tables cost ``2 * HALVES * ROWS`` minhashes
instead of ``2 * ROWS * HALVES**2``.  A half key that no other set shares can be in no
shared table key, so only shared half keys are paired up.  At a similarity of 0.8 a
pair shares a table key with probability 0.998, at 0.5 with 0.17, at 0.3 with 0.002, so
texts of one template seldom meet; a set in a group needs only one found link.

From the tables to links, without emitting the pairs of a group:

1. equal shingle sets collapse to one representative;
2. each table key ties its members to its smallest one, and the components of these
   ties are the candidate clusters (small or large);
3. a cluster of up to ``BLOCK`` members is one task; a larger one is cut by length
   class (a link needs sizes within a factor of 0.8, so only neighbouring classes
   meet) and hash into blocks, and each pair of blocks is a task of bounded size;
4. a task compares full shingle sets exactly and emits a spanning forest of the links
   it finds, fewer rows than members; no link between clusters members is lost;
5. components of all forests, by large-star / small-star rounds, are the result.

Defined cases: a null, empty or wordless text has no shingles, is linked with
nothing and kept; a text of fewer words than a shingle is one shingle; a null doc_id
is kept with a null component; rows that repeat a doc_id are one document; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm import shingles as S
from playtide.llm.common import bounded, components, materialize

SHINGLE, THRESHOLD = 5, 80
ROWS, HALVES = 5, 17
#: Up to so many ids of candidates are broadcast, so that the texts of all others are not shuffled.
INVOLVED_ROWS = 500_000
#: Members compared in one task at most: two blocks of this size.
BLOCK = 128


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Half keys of a shingle set: hashes of ``rows`` minhashes each, salted by their place."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * a + b).min(axis=0), out=low)
    parts = low.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        key = S.mix(key * np.uint64(0x100000001B3) + parts[:, j])
    # the lowest bit names the collection, so no place has to travel with a key
    return (key >> np.uint64(1) << np.uint64(1) | (np.arange(len(parts)) >= len(parts) // 2).astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, k: int = SHINGLE, rows: int = ROWS, halves: int = HALVES) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), halves."""
    a, b = _coefficients(2 * halves * rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                s = np.unique(S.shingle_hashes(S.word_hashes(t), k))
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    out.append((len(s), d[0], d[1], half_keys(s, a, b, rows)))
                else:
                    out.append((0, None, None, None))
            res = pd.DataFrame(out, columns=["n_shingles", "d1", "d2", "halves"])
            res.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield res.astype({"d1": "Int64", "d2": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, d1 long, d2 long, halves array<long>")


def candidate_clusters(sets: DataFrame) -> DataFrame:
    """node, component over the table keys of ``sets`` (node, halves), a materialised table."""
    each = sets.select("node", F.explode("halves").alias("hk"))
    shared = materialize(each.groupBy("hk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hk"))
    mine = each.join(shared, "hk").groupBy("node").agg(F.collect_list("hk").alias("h"))
    both = mine.select("node", F.filter("h", lambda x: x % 2 == 0).alias("as"), F.filter("h", lambda x: x % 2 != 0).alias("bs"))
    keys = materialize(
        both.select("node", F.explode("as").alias("a"), "bs").select("node", "a", F.explode("bs").alias("b")).select("node", F.xxhash64("a", "b").alias("key"))
    )
    heads = materialize(keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head"))
    ties = keys.join(heads, "key").where("node <> head").select(F.col("node").alias("src"), F.col("head").alias("dst")).distinct()
    return components(ties)


def _task_rows(members: DataFrame, block: int) -> DataFrame:
    """node, gid, side: the tasks in which each member of a cluster is compared."""
    classed = members.withColumn("lc", F.floor(F.log("n_shingles") / F.log(F.lit(100.0 / THRESHOLD)) + 1e-9).cast("int"))
    sizes = materialize(classed.groupBy("component", "lc").agg(F.count(F.lit(1)).alias("n")))
    plan = materialize(
        sizes.groupBy("component").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lc", F.ceil(F.col("n") / block).cast("int").alias("nb"))).alias("classes"))
    )
    m = classed.join(plan, "component")
    whole = m.where(F.col("total") <= block).select("node", F.col("component").cast("string").alias("gid"), F.lit(0).alias("side"))
    own = F.filter("classes", lambda c: c["lc"] == F.col("lc"))[0]["nb"]
    near = F.filter("classes", lambda c: F.abs(c["lc"] - F.col("lc")) <= 1)
    big = m.where(F.col("total") > block).select("node", "component", "lc", F.pmod(F.xxhash64("node"), own).cast("int").alias("b"), F.explode(near).alias("o"))
    big = big.select("node", "component", F.struct("lc", "b").alias("me"), F.explode(F.transform(F.sequence(F.lit(0), F.col("o.nb") - 1), lambda j: F.struct(F.col("o.lc").alias("lc"), j.alias("b")))).alias("other"))
    name = lambda s: F.concat_ws(".", s["lc"].cast("string"), s["b"].cast("string"))
    first, last = F.least("me", "other"), F.greatest("me", "other")
    split = big.select("node", F.concat_ws("|", F.col("component").cast("string"), name(first), name(last)).alias("gid"), F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), 1).otherwise(2).alias("side"))
    return whole.union(split)


def forest(nodes: list[int], sides: list[int], sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Spanning forest of the exact links among ``sets``; sets of sides 1 and 2 meet only across."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    side, root = np.array(sides), list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, mark = [], np.zeros(len(vocabulary), bool)
    for i, s in enumerate(sets[:-1]):
        mine = flat[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        rest = starts[i + 1]
        both = np.add.reduceat(mark[flat[rest:]], starts[i + 1 :] - rest, dtype=np.int64)
        mark[mine] = False
        ok = 100 * both >= threshold * (len(s) + sizes[i + 1 :] - both)
        ok &= (side[i + 1 :] != side[i]) | (side[i] == 0)
        for j in np.flatnonzero(ok) + i + 1:
            x, y = top(i), top(int(j))
            if x != y:
                root[y] = x
                out.append((nodes[i], nodes[int(j)]))
    return out


def verified_links(docs: DataFrame, members: DataFrame, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """src, dst: exact links that connect what is linked; ``members``: node, component, n_shingles."""
    tasks = _task_rows(members, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gid, held = None, []

        def close() -> list[tuple[int, int]]:
            return forest([h[0] for h in held], [h[1] for h in held], [h[2] for h in held])

        for pdf in batches:
            out = []
            for node, g, side, text in zip(pdf["node"], pdf["gid"], pdf["side"], pdf["text"], strict=True):
                if g != gid:
                    out += close()
                    gid, held = g, []
                s = np.unique(S.shingle_hashes(S.word_hashes(text), k))
                if len(s):
                    held.append((node, side, s))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")
        yield pd.DataFrame(close(), columns=["src", "dst"], dtype="int64")

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(bounded(members.select("node"), INVOLVED_ROWS), "node", "left_semi")
    return texts.join(tasks, "node").repartition("gid").sortWithinPartitions("gid").mapInPandas(run, "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    t = materialize(sketches(docs, k))
    live = t.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves")))
    clusters = candidate_clusters(classes.select("node", "halves"))
    members = materialize(clusters.join(classes.select("node", "n_shingles"), "node"))
    groups = components(verified_links(docs, members, k, block))
    named = materialize(classes.select("d1", "d2", "node").join(groups, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component")))
    out = t.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    cid = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), cid).alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose near-duplicate group has a smaller doc_id."""
    dropped = materialize(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(bounded(dropped), "doc_id", "left_anti").select(*docs.columns)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
r(node, low) as (select doc_id, doc_id from d union select e.y, r.low from r join e on e.x = r.node where r.low < e.y)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(low)::bigint as component_id, doc_id = min(low) as kept
from d join r on r.node = d.doc_id left join n using (doc_id) group by doc_id, n.n
"""
