"""Secret scans by character Markov models (DataFrame functions only).

Fixed patterns give the base spans.  Beyond them, every token of 16 characters or more,
whatever its length and characters, is compared (between dots, every part by itself)
under first-order character models: four of random strings (lower-case hexadecimal,
upper-case with digits, base 64, lower-case letters) and one of ordinary identifiers and
words.  A token whose best log-likelihood ratio exceeds ``MIN_RATIO`` in all and the
model's cutoff a character is a secret of kind ``random``; spans that touch a base span
are left to it.  The cutoff is the lowest of at least ``MIN_MEAN`` that accepts no more
than ``FALSE_SHARE`` of the ordinary tokens of the other half of the samples; what it finds of
the random ones there is reported as ``recall``.

The models are trained from labelled samples: random strings drawn by hashing
(``FIT_RANDOM`` of each alphabet) and ordinary tokens, which are the words of about
``FIT_DOCS`` documents chosen by a hash of the id, fixed identifiers, numbers, dates,
rules and one-letter paths.  Only the
bigram counts, at most the square of the alphabet for each model, reach the driver.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.spans import SPAN, count_of, find_spans, free_of, named, redacted

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET) + 1
FIT_RANDOM, FIT_DOCS = 2000, 2000
MIN_RATIO, MIN_MEAN, FALSE_SHARE = 16.0, 0.8, 0.0005
MARK = "[SECRET]"
MODELS = ["hex", "upper", "base64", "lower"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Words of which code joins its identifiers.
IDENTIFIER_WORDS = "get set is has new old user name file path size count index list map key value data type node tree item table column row start end first last next prev open close read write load save parse build create delete update insert select find search sort merge split join filter hash cache buffer stream event handler client server request response message error result status state config option default version module class method function test check value2 sha256 utf8 base64 http2 md5 int32 int64 float64".split()


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    lower_hint = text.rlike(r"(?i)pass|secret|token|key")
    assign = find_spans(text, ASSIGN, "assign", 0, lower_hint, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)
    access = find_spans(text, ACCESS, "access", 1, text.contains("AKIA"))
    hexes = find_spans(text, HEX, "hex", 2, text.rlike("[0-9a-f]{24}"))
    return F.sort_array(F.concat(assign, access, hexes))


def bigram_counts(samples: DataFrame) -> dict[str, dict[tuple[int, int], int]]:
    """Counts by model of neighbouring characters in ``samples`` (model, token)."""
    pairs = samples.where(F.length("token") >= 2).select("model", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("p"))
    out: dict[str, dict[tuple[int, int], int]] = {}
    code = lambda c: ALPHABET.find(c) + 1
    ok = pairs.where(F.col("p").rlike(r"^[A-Za-z0-9+/_=.-]{2}$"))
    for r in ok.groupBy("model", "p").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(r["model"], {})[code(r["p"][0]), code(r["p"][1])] = r["n"]
    return out


def labelled_samples(docs: DataFrame) -> DataFrame:
    """model, token: random strings by alphabet, and ordinary tokens."""
    spark = docs.sparkSession
    seed = spark.range(FIT_RANDOM, numPartitions=4).select(F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256).alias("h"))
    raw = F.base64(F.unhex("h"))
    random = (
        seed.select(F.lit("hex").alias("model"), F.col("h").alias("token"))
        .union(seed.select(F.lit("upper"), F.translate(F.upper(raw), "+/=", "")))
        .union(seed.select(F.lit("base64"), raw))
        .union(seed.select(F.lit("base64"), F.translate(raw, "+/=", "-_")))
        .union(seed.select(F.lit("lower"), F.translate(F.lower(raw), "0123456789+/=", "")))
    )
    total = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, FIT_DOCS / total)) + 1)
    words = some.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=.-]+")).alias("token")).where(F.length("token").between(2, 64) & ~F.col("token").rlike("[0-9]"))
    names = IDENTIFIER_WORDS
    joined = [f"{a}_{b}" for a in names for b in names] + [a + b.capitalize() for a in names for b in names] + [f"{a}.{b}-{a}" for a in names for b in names]
    fixed = spark.createDataFrame([(x,) for x in joined], "token string")
    # numbers, dates, rules and one-letter paths: unlike words, and no secrets
    number = F.substring(F.regexp_replace("h", "[a-f]", ""), 1, 20)
    date = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.conv(F.substring("h", 1, 3), 16, 10).cast("int") * 4), "yyyy-MM-dd")
    rule = F.repeat(F.substring(F.lit("-=_.+/"), F.pmod(F.xxhash64("h"), F.lit(6)).cast("int") + 1, F.lit(1)), F.lit(16) + F.pmod(F.xxhash64("h", F.lit("n")), F.lit(64)).cast("int"))
    path = F.concat_ws("/", F.split(F.substring(F.translate("h", "0123456789", "ghijklmnop"), 1, 12), ""))
    plain = seed.select(F.explode(F.array(number, F.concat(date, F.lit("-"), F.reverse(date)), F.concat_ws("-", date, date), rule, path)).alias("token"))
    return random.union(words.union(fixed).union(plain).select(F.lit("ordinary"), "token"))


def train(docs: DataFrame) -> dict:
    """tables (log-likelihood ratio by bigram of each random model against ordinary text), cut, recall.

    Bigrams are counted in one half of the samples, by a hash of the token; the other half sets the cutoff.
    """
    samples = labelled_samples(docs).withColumn("half", F.pmod(F.xxhash64("token"), F.lit(2)))
    counts = bigram_counts(samples.where("half = 0"))

    def logs(model: str, alpha: float) -> list[list[float]]:
        c = counts.get(model, {})
        rows = []
        for a in range(SIZE):
            total = sum(c.get((a, b), 0) for b in range(SIZE)) + alpha * SIZE
            rows.append([math.log((c.get((a, b), 0) + alpha) / total) for b in range(SIZE)])
        return rows

    plain = logs("ordinary", 0.5)
    tables = {m: [round(x - y, 2) for r, s in zip(logs(m, 0.05), plain, strict=True) for x, y in zip(r, s, strict=True)] for m in MODELS}
    # tokens as the scan cuts them; only counts by score step reach the driver
    tried = samples.where("half = 1").select((F.col("model") == "ordinary").alias("plain"), F.explode(F.split("token", r"\.")).alias("token")).where(F.length("token") >= 16)
    mean = F.floor(best_ratio(F.col("token"), tables) / F.length("token") * 100).cast("int")
    steps = tried.groupBy("plain", mean.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()
    above = lambda plain, cut: sum(r["n"] for r in steps if r["plain"] == plain and r["m"] >= cut)
    total = {p: max(1, above(p, -(10**9))) for p in (True, False)}
    cut = next(c for c in range(round(100 * MIN_MEAN), 10**6) if above(True, c) <= FALSE_SHARE * total[True])
    return {"tables": tables, "cut": cut / 100, "recall": above(False, cut) / total[False]}


def best_ratio(token: Column, tables: dict[str, list[float]]) -> Column:
    return F.greatest(*[ratio(token, t) for t in tables.values()])


def ratio(token: Column, table: list[float]) -> Column:
    """Sum of the table over the token's bigrams."""
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<float>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, ch: Column) -> Column:
        code = F.position(ch, F.lit(ALPHABET))
        gain = F.when(acc["last"] >= 0, F.get(literal, acc["last"] * SIZE + code).cast("double")).otherwise(0.0)
        return F.struct(code.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, base and found: spans of the patterns, and all spans with those of the models."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = body.withColumn("base", base_spans(F.col("text")))
    token = find_spans(F.col("text"), TOKEN, "random", 3, F.col("text").rlike("[A-Za-z0-9+/_=-]{16}"))
    free = based.withColumn("tokens", free_of(token, F.col("base")))
    scored = free.withColumn("scores", F.transform("tokens", lambda s: best_ratio(s["match"], model["tables"])))
    good = F.filter(
        F.transform("tokens", lambda s, i: F.when((F.get("scores", i) >= MIN_RATIO) & (F.get("scores", i) >= model["cut"] * F.length(s["match"])), s)), lambda s: s.isNotNull()
    )
    return scored.select("doc_id", "text", "base", F.sort_array(F.concat("base", good)).cast(SPAN).alias("found"))


def redact_secrets(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every secret of the text replaced by ``MARK``; null texts stay null."""
    model = train(docs) if model is None else model
    others = [c for c in docs.columns if c != "text"]
    found = scan(docs.select(F.struct(F.struct(*others).alias("rest"), F.col("text").isNull().alias("none")).alias("doc_id"), "text"), model)
    clean = F.when(~F.col("doc_id.none"), redacted(F.col("text"), F.col("found"), MARK))
    return found.select("doc_id.rest.*", clean.alias("text")).select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    return found.select(
        "doc_id", count_of(F.col("base"), "assign").alias("n_assign"), count_of(F.col("base"), "access").alias("n_access"), count_of(F.col("base"), "hex").alias("n_hex"),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("found")).alias("spans"),
    )
