"""A published search index that follows inserted, changed and deleted entities.

The index is split by entity into shards, its counts by key into buckets.  A delta takes
the new form of changed entities and the ids of deleted ones, and touches

* the shards that hold such an entity: their other rows are kept, the entities' postings
  are made anew;
* the buckets of the keys whose count changes, by signed counts of old and new postings.

All other files stay as they are.  The result equals an index built from the final rows.

Defined cases: an entity both changed and deleted is changed; deleting an unknown entity
does nothing; an empty delta publishes a generation with the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.operators import search as S
from playtide.sources import generations as G
from playtide.sources.publish import scratch, side

SHARDS, BUCKETS = 32, 64
PARAMS = {"index": "search", "version": 2, "shards": SHARDS, "buckets": BUCKETS}


def shard(entity: str = "entity") -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(SHARDS)).cast("int")


def bucket() -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(BUCKETS)).cast("int")


def index_tables(entities: DataFrame, postings: DataFrame, counts: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    return {"entities": (entities.withColumn("shard", shard()), "shard"), "postings": (postings.withColumn("shard", shard()), "shard"), "counts": (counts.withColumn("bucket", bucket()), "bucket")}


def publish_index(spark: SparkSession, root: str, docs: DataFrame, source: str) -> G.Generation:
    """A whole index of ``docs``."""
    index = S.build_index(docs)
    return G.publish(spark, root, index_tables(index.entities, index.postings, index.counts), PARAMS, source)


def read_index(spark: SparkSession, now: G.Generation) -> S.SearchIndex:
    return S.SearchIndex(now.read(spark, "entities").drop("shard"), now.read(spark, "postings").drop("shard"), now.read(spark, "counts").drop("bucket"))


def apply_delta(spark: SparkSession, now: G.Generation, changed: DataFrame, deleted: DataFrame, source: str) -> G.Generation:
    """The next generation: ``changed`` as in ``build_index``, ``deleted`` (entity)."""
    fresh = scratch(S.entity_rows(changed))
    touched = scratch(fresh.select("entity").union(deleted.where("entity is not null").select("entity")).distinct())
    shards = [r[0] for r in touched.select(shard()).distinct().collect()]  # SHARDS at most
    touched = side(touched)
    old_entities, old_postings = (now.read(spark, t, shards).drop("shard") for t in ("entities", "postings"))
    new_postings = scratch(S.posting_rows(fresh))
    out_postings = old_postings.join(touched, "entity", "left_semi")
    signed = S.count_rows(new_postings).union(S.count_rows(out_postings).withColumn("n", -F.col("n")))
    moved = scratch(signed.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0"))
    buckets = [r[0] for r in moved.select(bucket()).distinct().collect()]  # BUCKETS at most
    counts = now.read(spark, "counts", buckets).drop("bucket").union(moved).groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")
    entities = old_entities.join(touched, "entity", "left_anti").unionByName(fresh)
    postings = old_postings.join(touched, "entity", "left_anti").unionByName(new_postings)
    tables = index_tables(entities, postings, counts)
    return G.publish(spark, now.root, tables, PARAMS, source, base=now, replaced={"entities": shards, "postings": shards, "counts": buckets})
