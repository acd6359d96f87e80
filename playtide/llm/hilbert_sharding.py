"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Each dimension is quantised to ``2**BITS`` order-preserving, equally filled steps,
the steps of a row name a cell of a small grid, and the cell's place on the Hilbert
curve orders the rows.  The run of rows is cut into shards whose row counts differ
by at most one (law ``rows``), so a shard covers a compact box of every dimension
and file statistics prune on any of them.

Rows are never sorted in one task: counts by (curve index, salt) give every such
group its first rank, and rows are ranked inside their group only.  The salt is a
hash of the id, so a third of all rows in one cell still spreads over ``SALTS`` tasks
per cell.

Defined cases: a null text counts one byte and has crc32 0; null dimensions come
first in their order; repeated rows and ties are ranked next to each other; with
fewer rows than shards the first shards hold one row each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.llm.common import bounded, materialize, ranked

BITS = 4
SHARDS = 16
#: Tasks over which one cell's rows may spread.
SALTS = 256


def curve_index(cell: tuple[int, ...], bits: int) -> int:
    """Place of a grid cell on the Hilbert curve (Skilling's transpose form)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | ((v ^ t) >> b & 1)
    return place


def _index_table(dims: int, bits: int) -> Column:
    """Array literal: cell number -> curve index; its size is 2**(dims * bits), whatever the data."""
    side = 1 << bits
    cells = [curve_index(tuple(c // side**k % side for k in range(dims - 1, -1, -1)), bits) for c in range(side**dims)]
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add ``<dim>_q``, the equal-fill step of each dimension, by value order.

    Exact: counts of distinct values, pre-aggregated.  Equal values share a step.
    """
    out = df
    for d in dims:
        counts = materialize(df.groupBy(d).agg(F.count(F.lit(1)).alias("n")))
        rows = counts.agg(F.sum("n")).first()[0] or 1
        steps = _running_share(counts, d, rows, bits)
        out = out.join(bounded(steps), out[d].eqNullSafe(steps["_v"]), "left").drop("_v").withColumn(f"{d}_q", F.col("_q")).drop("_q")
    return out


def _running_share(counts: DataFrame, d: str, rows: int, bits: int) -> DataFrame:
    """(_v, _q): value and step, from range-partitioned counts and the offsets of the ranges."""
    n = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(counts.repartitionByRange(n, F.col(d).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    per = ranged.groupBy("_part").agg(F.sum("n").alias("c"))
    offs = materialize(per.select("_part", F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy(F.col(d).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = ranged.withColumn("_b", before).join(F.broadcast(offs), "_part")
    middle = F.col("_off") + F.col("_b") + F.col("n") / 2
    return materialize(run.select(F.col(d).alias("_v"), F.least(F.floor(middle * (1 << bits) / rows), F.lit((1 << bits) - 1)).cast("int").alias("_q")))


def hilbert_shards(df: DataFrame, dims: list[str], id_col: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot``; ``df`` must be a materialised, narrow table."""
    side = 1 << bits
    cell = F.lit(0)
    for d in dims:
        cell = cell * side + F.col(f"{d}_q")
    placed = materialize(
        quantised(df, dims, bits).withColumn("curve", F.get(_index_table(len(dims), bits), cell.cast("int"))).drop(*[f"{d}_q" for d in dims]).withColumn("_one", F.lit(0))
    )
    # the rank of a row over the whole curve: its group is (curve, salt)
    salt = F.col("curve") * SALTS + F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")
    total = placed.count()
    numbered = ranked(placed, ["_one"], [id_col], salt, "_rank")
    small, extra = divmod(total, shards)
    wide = extra * (small + 1)  # rows in the first `extra` shards, which hold one more
    r = F.col("_rank")
    if small:
        shard = F.when(r < wide, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - wide) / small)).cast("int")
    else:
        shard = r.cast("int")
    first = F.when(shard <= extra, shard * (small + 1)).otherwise(wide + (shard - extra) * small)
    return numbered.select(*df.columns, "curve", shard.alias("shard"), (r - first).cast("long").alias("slot"))


def metadata(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = materialize(metadata(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = hilbert_shards(meta, ["lang", "source", "size"], "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
