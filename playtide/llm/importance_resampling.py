"""Importance resampling of documents towards the word distribution of a target table.

Every feature (a run of one to ``max_n`` words, joined by a space) falls into one of
``buckets`` buckets by the crc32 of its bytes.  A bucket's gain is the logarithm of its
smoothed share in the target over its smoothed share in the documents, in thousandths;
a document's weight is the sum of the gains of its features.  Gumbel noise from a hash
of the id is added, and the highest scores are drawn: a sample without replacement in
proportion to the weights, with an order.

Only DataFrame functions run on the rows:

1. words are cut and hashed once; the table of bucket numbers is written, a few bytes a word;
2. bucket counts are a ``groupBy`` over the exploded arrays, at most ``buckets`` rows a task;
3. gains (``buckets`` rows, bounded by that parameter) are broadcast to the exploded
   arrays, and the sums leave a task as one row a document;
4. scores are sorted by ranges; a row's rank is its place in its range plus the rows of the
   ranges before it.

Defined cases: a null or wordless text has no features and weight 0; a null id has no
score and is never drawn nor counted among the eligible; rows that repeat an id are
documents of their own; empty tables give an empty result, an empty target or empty
documents smooth to even shares; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import materialize
from playtide.operators.ranking import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything else belongs to a word.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, MIN_WORDS, PERCENT, MAX_N = 10_000, 2024, 20, 10, 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), lambda w: w != "")


def bucketed(docs: DataFrame, id_col: str, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """The written table (row, id, n_words, b): the bucket of every feature of every row."""

    def runs(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.crc32(F.array_join(F.slice(F.col("_w"), i, n), " ").cast("binary")))

    single = F.transform("_w", lambda w: F.crc32(w.cast("binary")))
    b = F.transform(F.concat(single, *[runs(n) for n in range(2, max_n + 1)]), lambda c: (c % buckets).cast("int"))
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col("text")).alias("_w"))
    return materialize(cut.select("row", "id", F.size("_w").cast("long").alias("n_words"), b.alias("b")))


def bucket_counts(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, written; ``source`` and ``target`` are tables of ``bucketed``."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = materialize(every.join(bucket_counts(source, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]))
    totals = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("_S"), F.coalesce(F.sum("t"), F.lit(0)).alias("_T"))
    share = ((F.col("t") + 1) * (F.col("_S") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("_T") + buckets)).cast("double")
    return materialize(counts.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain")))


def weighted(table: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, id, n_words, n_features, weight, score) of every row of ``table``, written."""
    long = table.select("row", "id", "n_words", F.size("b").cast("long").alias("n_features"), F.explode_outer("b").alias("bucket"))
    sums = long.join(F.broadcast(gain), "bucket", "left").groupBy("row", "id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return materialize(sums.withColumn("score", F.col("weight") + noise))


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... of the highest ``percent`` scores of the eligible rows, else null."""
    fits = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    most = scored.where(fits).count() * percent // 100
    placed = numbered(scored.withColumn("_last", (~fits).cast("int")), "_place", F.col("_last").asc(), F.col("score").desc_nulls_last(), F.col("id").asc_nulls_last(), F.col("row").asc())
    return placed.withColumn("rank", F.when((F.col("_last") == 0) & (F.col("_place") <= most), F.col("_place").cast("long"))).drop("_last", "_place")


def resample(docs: DataFrame, target: DataFrame, id_col: str, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs``: id, n_words, n_features, weight, score and rank; ``target`` needs a text only."""
    table = bucketed(docs, id_col, max_n, buckets)
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("_id"), "text"), "_id", max_n, buckets)
    return drawn(weighted(table, gains(table, wanted, buckets), seed), min_words, percent).drop("row").withColumnRenamed("id", id_col)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, items, "doc_id").select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a text in SQL: the table of byte steps comes from the polynomial.
CRC_TABLE = "crc_steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps)"


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, beside ``crc_steps``."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295)"


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
with {CRC_TABLE},
d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as w from documents),
dw as (select rid, unnest(w) as word from d),
bw as (select unnest({_WORDS}) as word from benchmark where text is not null),
hashed as (select word, {crc_sql("word")} % {BUCKETS} as bucket from (select word from dw union select word from bw), crc_steps),
s as (select bucket, count(*) as n from dw join hashed using (word) group by 1),
t as (select bucket, count(*) as n from bw join hashed using (word) group by 1),
sums as (select (select coalesce(sum(n), 0) from s)::double as big_s, (select coalesce(sum(n), 0) from t)::double as big_t),
gain as (select bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (big_s + {BUCKETS})) / ((s.n + 1) * (big_t + {BUCKETS}))))::bigint as g from s left join t using (bucket), sums),
weights as (select rid, sum(g)::bigint as weight from dw join hashed using (word) join gain using (bucket) group by rid),
scored as (select rid, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint as score
  from d left join weights using (rid)),
placed as (select *, row_number() over (order by (n_features >= {MIN_WORDS} and score is not null) desc, score desc, doc_id, rid) as place,
  count(*) filter (where n_features >= {MIN_WORDS} and score is not null) over () as eligible from scored)
select doc_id, n_features, weight, score, case when place <= {PERCENT} * eligible // 100 then place end::bigint as rank from placed
"""
