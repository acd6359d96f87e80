"""Exact top-k inner-product search over norm buckets.

Vectors are quantised to whole numbers and laid out by decreasing length.  A bucket is a
run of that order, so its longest vector bounds it: a query needs, from a bucket with
longest length ``l``, a cosine of at least ``threshold / (|query| * l)``, its local
threshold there.  For each query and bucket one of these is chosen:

* above 1: the bucket is left out (whole row groups are, by the length in the scan's filter);
* length pruning: only the bucket's first rows are long enough, one matrix product verifies them;
* coordinate pruning: a vector within that angle of the query has each of the query's
  largest coordinates in an interval; sorted coordinates give the rows in it, where they
  are ``SELECTIVE`` times fewer than by length, and their products verify them.

Pruning never loses a row, so results are exact, ties by id included.

1. The written table is cut by ranges of length, one file a task, in order inside a file.
2. Thresholds start from the scores of each query against the longest ``SEED_ROWS`` vectors.
3. Queries go in blocks of ``BLOCK_CELLS`` components at most, one broadcast and one pass over
   the table a block; a task keeps the best k of each query of the block and its threshold
   rises from bucket to bucket.  Few rows leave a task, as most are under the first threshold.
4. The best k of each query over all tasks are ranked.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; of rows that repeat an id the smallest vector counts; of
vectors of unequal dimension the missing components count as zero, so an empty vector
scores 0; components beyond the range of a long take its end, and so do scores; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.llm.common import materialize, scratch_dir
from playtide.operators.ranking import numbered

SCALE, K, EVERY = 256, 5, 50
SEED_ROWS, BUCKET_ROWS, QUERY_ROWS = 4096, 4096, 512
BLOCK_CELLS, BUCKET_CELLS = 1 << 22, 1 << 20
#: Coordinate pruning must leave so many times fewer rows than length pruning; coordinates that it looks at.
SELECTIVE, FOCUS = 4, 3
#: Whole numbers below this are exact in doubles, and so are sums of products whose bound is below it.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, length, x), written: the vectors that take part, as whole numbers."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = df.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))
    once = kept.groupBy("id").agg(F.min("x").alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return materialize(once.select("id", F.sqrt(square).alias("length"), "x"))


def by_length(vectors: DataFrame) -> DataFrame:
    """``vectors`` written by decreasing length, a range of it in each file."""
    rows, spark = vectors.count(), vectors.sparkSession
    parts = max(1, rows >> 20, min(rows // BUCKET_ROWS, 2 * spark.sparkContext.defaultParallelism))
    order = [F.col("length").desc(), F.col("id").asc()]
    return materialize(vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def matrix(lists: pa.Array | pa.ChunkedArray, integers: bool = False) -> np.ndarray:
    """Rows of the lists as doubles (as Python numbers where asked), missing components zero."""
    rows = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pa.compute.list_value_length(rows))
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), object if integers else np.float64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(rows.flatten())
    return out


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows of ``q`` with rows of ``p``, exact; ``bound`` is the product of the largest lengths."""
    width = min(q.shape[1], p.shape[1])
    a, b = q[:, :width], p[:, :width]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[max(LEAST, min(MOST, int(v))) for v in row] for row in m.tolist()], object).reshape(m.shape)
    full = whole(a) @ whole(b).T
    return np.array([[max(LEAST, min(MOST, v)) for v in row] for row in full.tolist()], np.int64).reshape(full.shape)


class Best:
    """The best k of each query so far, with the score and the id that a row must beat."""

    def __init__(self, ids: np.ndarray, k: int, threshold: np.ndarray, last: np.ndarray) -> None:
        self.ids, self.k, self.threshold, self.last = ids, k, threshold.copy(), last.copy()
        self.rows = tuple(np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Take rows (query's index, score, id) that beat the thresholds."""
        t = self.threshold[query]
        better = ((score > t) | ((score == t) & (found <= self.last[query]))) & (found != self.ids[query])
        if not better.any():
            return
        q, s, i = (np.concatenate([a, b[better]]) for a, b in zip(self.rows, (query, score, found), strict=True))
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kept = place < self.k
        self.rows = (q[kept], s[kept], i[kept])
        full = place == self.k - 1
        self.threshold[q[full]], self.last[q[full]] = s[full], i[full]


def intervals(unit_q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinate of unit vectors within the angle of ``cosine`` of a query with coordinate ``unit_q``."""
    own, angle = np.arccos(np.clip(unit_q, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, own + angle)) - 1e-9, np.cos(np.maximum(0, own - angle)) + 1e-9


def scan_bucket(ids: np.ndarray, lengths: np.ndarray, p: np.ndarray, q: np.ndarray, q_len: np.ndarray, best: Best) -> dict[str, int]:
    """Take the rows of one bucket (longest first) into ``best``; returns rows left out, and rows verified by each way."""
    longest, used = float(lengths[0]), {"left_out": 0, "length": 0, "coordinate": 0}
    if not p.shape[1] or not q.shape[1]:
        p, q = np.zeros((len(p), 1)), np.zeros((len(q), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(best.threshold > 0, best.threshold / q_len * (1 - 1e-9), 0.0)  # length that a vector needs
    need[np.isnan(need)] = 0.0
    prefix = np.searchsorted(-lengths, -need, side="right")
    used["left_out"] = int((len(ids) - prefix).sum())
    cosine = need / longest if longest > 0 else np.zeros(len(q))
    by_coordinate: dict[int, np.ndarray] = {}
    some = np.flatnonzero((prefix > 0) & (cosine > 0) & (q_len > 0))
    if len(some) and longest > 0 and longest < EXACT:
        width = min(q.shape[1], p.shape[1])
        unit_p = p[:, :width] / np.where(lengths > 0, lengths, 1)[:, None]
        unit_q = q[some] / q_len[some, None]
        focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
        low, high = intervals(np.take_along_axis(unit_q, focus, 1), cosine[some, None])
        inside = focus < width  # a coordinate that the bucket's vectors lack prunes nothing
        least, most = unit_p.min(axis=0), unit_p.max(axis=0)
        near = np.minimum(focus, width - 1)
        prunes = (inside & ((low > least[near]) | (high < most[near]))).any(axis=1)
        if prunes.any():
            order = np.argsort(unit_p, axis=0)
            ranked = np.take_along_axis(unit_p, order, 0)
            for j in np.flatnonzero(prunes):
                ends = [(np.searchsorted(ranked[:, f], a), np.searchsorted(ranked[:, f], b, side="right"), f, a, b) for f, a, b in zip(focus[j], low[j], high[j], strict=True) if f < width]
                start, end, f, *_ = min(ends, key=lambda e: e[1] - e[0])
                k = int(some[j])
                if (end - start) * SELECTIVE <= prefix[k]:
                    rows = np.sort(order[start:end, f])
                    rows = rows[rows < prefix[k]]
                    for _, _, g, a, b in ends:
                        rows = rows[(unit_p[rows, g] >= a) & (unit_p[rows, g] <= b)]
                    by_coordinate[k] = rows
    for k, rows in by_coordinate.items():
        used["coordinate"] += len(rows)
        if len(rows):
            s = products(q[k : k + 1], p[rows], float(q_len[k]) * longest)[0]
            best.add(np.full(len(rows), k), s, ids[rows])
    rest = np.setdiff1d(np.flatnonzero(prefix > 0), np.fromiter(by_coordinate, np.int64, len(by_coordinate)))
    rest = rest[np.argsort(prefix[rest], kind="stable")]
    for at in range(0, len(rest), QUERY_ROWS):
        some = rest[at : at + QUERY_ROWS]
        n = int(prefix[some[-1]])
        used["length"] += n * len(some)
        s = products(q[some], p[:n], float(q_len[some].max()) * longest)
        row, col = np.nonzero(s >= best.threshold[some, None])
        best.add(some[row], s[row, col], ids[col])
    return used


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, rows) of runs of decreasing length; a bucket ends with its batch, its rows, or a tenth of its length."""
    for batch in batches:
        ids, lengths = np.asarray(batch["id"]), np.asarray(batch["length"])
        start = 0
        while start < len(ids):
            width = max(1, len(batch["x"][start]))
            end = min(len(ids), start + max(1, min(BUCKET_ROWS, BUCKET_CELLS // width)))
            stop = np.flatnonzero((lengths[start + 1 : end] < 0.9 * lengths[start]) | (lengths[start + 1 : end] > lengths[start : end - 1]))
            if len(stop):
                end = start + 1 + int(stop[0])
            yield ids[start:end], lengths[start:end], matrix(batch["x"].slice(start, end - start))
            start = end


def with_thresholds(queries: DataFrame, vectors: DataFrame, k: int, seed_rows: int = SEED_ROWS) -> DataFrame:
    """``queries`` with the score and id of the k-th best of the longest vectors (null where those are fewer)."""
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 1
    rows = max(k + 1, min(seed_rows, BUCKET_CELLS // max(1, width)))
    seeds = vectors.orderBy(F.col("length").desc(), F.col("id")).limit(rows).toArrow()
    s_ids, s_len, s_x = np.asarray(seeds["id"]), np.asarray(seeds["length"]), matrix(seeds["x"])
    held = queries.sparkSession.sparkContext.broadcast((s_ids, s_len, s_x))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, x = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                n = part.num_rows
                best = Best(np.asarray(part["id"]), k, np.full(n, LEAST), np.full(n, MOST))
                scan_bucket(ids, lengths, x, matrix(part["x"]), np.asarray(part["length"]), best)
                known = best.threshold > LEAST
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["length"], part["x"], pa.array(best.threshold, mask=~known), pa.array(best.last, mask=~known)], ["id", "length", "x", "threshold", "last"]
                )

    return queries.mapInArrow(start, "id long, length double, x array<long>, threshold long, last long")


def search_block(table: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task for the queries of ``block``."""
    q_len = np.asarray(block["length"])
    threshold, last = (np.asarray(pa.compute.fill_null(block[c], end)) for c, end in (("threshold", LEAST), ("last", MOST)))
    held = table.sparkSession.sparkContext.broadcast((np.asarray(block["id"]), q_len, matrix(block["x"]), threshold, last))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, x, floor, ends = held.value
        best = Best(ids, k, floor, ends)
        for row_ids, row_lengths, rows in buckets(batches):
            scan_bucket(row_ids, row_lengths, rows, x, lengths, best)
        q, s, i = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(threshold > 0, threshold / q_len * (1 - 1e-9), 0.0)
    cut = float(np.nan_to_num(need, nan=0.0).min()) if len(need) else 0.0
    return table.where(F.col("length") >= cut).select("id", "length", "x").mapInArrow(scan, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query with the other rows of ``vectors``.

    ``vectors`` and ``queries``, some of them, are tables of ``quantised``.
    """
    spark = vectors.sparkSession
    table = by_length(vectors)
    asked = materialize(numbered(materialize(with_thresholds(queries, vectors, k)), "_place", F.col("id").asc()))
    most = asked.agg(F.max("_place"), F.max(F.size("x"))).first()
    rows = max(1, block_cells // max(1, most[1] or 1))
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(path)
    for first in range(0, most[0] or 0, rows):
        block = asked.where(F.col("_place").between(first + 1, first + rows)).toArrow()
        search_block(table, block, k).write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q, v c where q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from pairs)
select query_id, place::int as rank, vec_id, score from placed where place <= {K}
"""
