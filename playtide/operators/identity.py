"""Connected components of merge links, for version groups of any size, and names that begin with others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.sources.publish import scratch


def connected(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, component (its smallest node) of undirected ``edges`` (src, dst).

    Each round takes the smallest label among the neighbours, hands it to the root and then
    follows the label's own label, so a long chain shortens to less than half in a round.
    A round is written to the shared folder and read again: no lineage grows and nothing is
    gathered on the driver.  Labels only sink, so an equal sum of them means that none moved.
    """
    both = scratch(edges.where("src <> dst").select("src", "dst").union(edges.where("src <> dst").select("dst", "src")).distinct())
    labels = scratch(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    total = None
    for _ in range(max_rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.src).select("node", F.least("component", "m").alias("c"))
        # a node's label may have a smaller label itself; a root hands its new label down as well
        hooks = step.join(labels.select(F.col("node").alias("n"), F.col("component").alias("root")), step.node == F.col("n")).groupBy("root").agg(F.min("c").alias("low"))
        moved = step.join(hooks, step.c == hooks.root, "left").select("node", F.least("c", F.coalesce("low", "c")).alias("component"))
        moved = scratch(moved)
        labels = scratch(moved.join(moved.toDF("n", "up"), F.col("component") == F.col("n")).select("node", F.col("up").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
    raise RuntimeError("components did not settle")


def prefix_pairs(rows: DataFrame, key: str, group: str, name: str) -> DataFrame:
    """``key``, longer: rows of one ``group`` whose ``name`` begins with the shorter name of another, as LIKE reads it.

    Every beginning of a distinct name meets the names that are equal to it, so work grows with
    the names and the pairs found.  Only names that hold a wildcard (% or _) are compared
    with all distinct names of their group.
    """
    held = rows.where(F.col(group).isNotNull() & F.col(name).isNotNull()).select(key, F.col(group).alias("_g"), F.col(name).alias("_n"))
    names = scratch(held.select("_g", "_n").distinct())
    short, wild = names.withColumnRenamed("_n", "_a"), F.col("_a").rlike("[%_]")
    cuts = names.where("_n <> ''").select("_g", F.col("_n").alias("_b"), F.explode(F.sequence(F.lit(0), F.length("_n") - 1)).alias("_i"))
    plain = cuts.withColumn("_a", F.substring("_b", F.lit(1), F.col("_i"))).join(short.where(~wild), ["_g", "_a"]).select("_g", "_a", "_b")
    pattern = F.concat(F.replace("_a", F.lit("\\"), F.lit("\\\\")), F.lit("%"))  # a backslash stands for itself
    loose = short.where(wild).join(names.withColumnRenamed("_n", "_b"), "_g").where((F.length("_b") > F.length("_a")) & F.like(F.col("_b"), pattern))
    found = scratch(plain.unionByName(loose.select("_g", "_a", "_b")))
    first = held.join(found, (held["_n"] == found["_a"]) & (held["_g"] == found["_g"])).select(key, found["_g"], "_b")
    second = held.select(F.col(key).alias("longer"), F.col("_g"), F.col("_n").alias("_b"))
    return first.join(second, ["_g", "_b"]).where(F.col(key) != F.col("longer")).select(key, "longer")
