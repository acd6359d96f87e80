"""Quality rules whose cutoffs carry an exact bound on false rejection (DataFrame functions only).

Each rule is a ratio of a text; a rule rejects a text above its cutoff.  For each
stratum, the labelled good texts that pass the base tests are the holdout.  A
cutoff is admissible if the exact binomial test rejects "this cutoff rejects at
least ``risk / rules`` of the good texts" at level ``delta / (rules * strata)``.  The
cutoffs of a rule are tried from the highest down and the first failure ends them
(fixed-sequence testing, so their number costs nothing; the tests are nested, so the
lowest admissible cutoff is the last before a failure); rules and strata are corrected
for by Bonferroni.
A stratum with too few labels to prove anything gets no cutoff, so it rejects nothing.

Defined cases: a null or empty text has no words and fails the base test; a null
stratum value is the stratum ``und``; null labels are ignored; a document with
several labels is good if all are 1; repeated rows give repeated rows; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.common import bounded, materialize

#: Bound on the share of good texts of a stratum that all rules together reject.
RISK = 0.05
#: Probability that any of the bounds fails.
DELTA = 0.05
#: Candidate cutoffs of every rule, lowest first.
CUTOFFS = [round(0.02 * k, 2) for k in range(1, 50)]
#: Spaces of the contract: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = ["r_symbols", "r_dup_lines", "r_repeats", "r_upper", "r_bangs"]


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs instead of ``text``."""
    keep = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    one = df.select(
        *keep,
        body.alias("_t"),
        F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias("_w"),
        F.filter(F.split(body, "\n"), lambda s: F.translate(s, SPACES, "") != "").alias("_l"),
    )
    two = one.select(
        *keep,
        F.size("_w").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.size("_l").alias("n_lines"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("n_bangs"),
        F.when(
            F.size("_w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2])),
        ).alias("_h"),
    )
    rest = [c for c in two.columns if c != "_h"]
    # windows in order of (hash, place): equal windows stand side by side
    three = two.select(
        *rest,
        F.when(
            F.size("_h") > F.size(F.array_distinct("_h")),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_p"),
    )
    twin = lambda p, k: ((k > 0) & (F.get(F.col("_p"), k - 1)["h"] == p["h"])) | F.coalesce(F.get(F.col("_p"), k + 1)["h"] == p["h"], F.lit(False))
    four = three.select(*rest, F.sort_array(F.transform(F.filter("_p", twin), lambda p: p["i"])).alias("_r"))
    covered = F.aggregate(
        F.transform("_r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_r"), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    five = four.select(*rest, F.when(F.col("_r").isNull(), 0).otherwise(covered).alias("n_repeat_words"))
    return five.select(*keep, *[F.col(c).cast("long").alias(c) for c in five.columns if c not in keep])


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat_words) > 50 * F.col(n_words))


def with_ratios(df: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns(
        {
            "r_symbols": part("n_symbols", "word_chars"),
            "r_dup_lines": part("n_dup_lines", "n_lines"),
            "r_repeats": part("n_repeat_words", "n_words"),
            "r_upper": part("n_upper", "word_chars"),
            "r_bangs": part("n_bangs", "word_chars"),
        }
    )


def _log_gamma(z: Column) -> Column:
    """Of z >= 1, by Stirling's series at z + 10; exact to about 1e-12."""
    y = z + 10
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    shift = F.lit(0.0)
    for i in range(10):
        shift = shift + F.log(z + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p, summed downwards until terms vanish; 1 for larger k (above any level of interest)."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    odds = (1 - p) / p
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        i = k - j + 1  # from i successes to i - 1
        term = acc["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["total"])
    return F.when(k < n * p, top * total).otherwise(1.0)


def select_cutoffs(good: DataFrame, stratum: str, rules: list[str], risk: float = RISK, delta: float = DELTA, cutoffs: list[float] = CUTOFFS) -> DataFrame:
    """One row per stratum and rule with an admissible cutoff: stratum, rule, cutoff, n_good, n_rejected.

    ``good`` holds one row per labelled good text.  It is pre-aggregated to counts
    by stratum, rule and cutoff step before anything is shuffled.
    """
    step = lambda r: F.size(F.filter(F.lit(cutoffs), lambda c: F.col(r) > c))
    long = good.select(stratum, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step(r).alias("steps")) for r in rules])).alias("x")).select(stratum, "x.*")
    counts = materialize(long.groupBy(stratum, "rule", "steps").agg(F.count(F.lit(1)).alias("n")))
    # a text with s steps is rejected by the first s cutoffs
    cells = counts.groupBy(stratum, "rule").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("steps", "n")).alias("by"))
    tried = cells.select(
        stratum,
        "rule",
        "n_good",
        "by",
        F.posexplode(F.lit(cutoffs)).alias("at", "cutoff"),
    ).withColumn("n_rejected", F.aggregate(F.transform("by", lambda b: F.when(b["steps"] > F.col("at"), b["n"]).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b))
    strata = counts.select(stratum).distinct().count()
    level = delta / max(1, len(rules) * strata)
    passed = tried.where(binomial_tail(F.col("n_good"), F.col("n_rejected"), risk / len(rules)) <= level)
    best = passed.groupBy(stratum, "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("b"))
    return best.select(stratum, "rule", "b.*")


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """row (struct of the ``carry`` columns), the counts, base_failed, kept and rejected_by, one row per row of ``docs``.

    ``docs`` needs doc_id, text and lang (the stratum); ``labels`` doc_id and quality.
    The counts are written once with what is carried, then read for the holdout and
    for the verdict; texts are never shuffled.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col("doc_id").alias("id"), "text", F.coalesce("lang", F.lit("und")).alias("stratum"))
    counted = materialize(with_ratios(text_counts(rows)).withColumn("base_failed", base_failed()))
    rated = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q")).where("q = 1")
    good = counted.where(~F.col("base_failed")).select("id", "stratum", *RULES).join(rated, "id", "left_semi")
    chosen = select_cutoffs(good, "stratum", RULES, risk, delta)
    wide = materialize(chosen.groupBy("stratum").pivot("rule", RULES).agg(F.first("cutoff")).select(F.col("stratum").alias("s"), *[F.col(r).alias(f"c_{r}") for r in RULES]))
    joined = counted.join(bounded(wide), F.col("stratum") == F.col("s"), "left")
    hit = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"c_{r}"), F.lit(r)) for r in RULES]))
    return joined.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(hit) == 0)).alias("kept"), F.concat_ws(",", hit).alias("rejected_by"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judged(docs, labels, docs.columns).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels, ["doc_id"]).select("row.doc_id", "*").drop("row")


_GRID = ", ".join(f"({c})" for c in CUTOFFS)
_PAIRS = {"r_symbols": "n_symbols / greatest(word_chars, 1)", "r_dup_lines": "n_dup_lines / greatest(n_lines, 1)", "r_repeats": "n_repeat_words / greatest(n_words, 1)", "r_upper": "n_upper / greatest(word_chars, 1)", "r_bangs": "n_bangs / greatest(word_chars, 1)"}
ORACLE_SQL = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as win
      from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from g) where c >= 2),
cov as (select rid, count(distinct i + o) as n from d, (values (0), (1), (2)) v(o) group by rid),
c as (select doc_id, rid, stratum, len(w) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(cov.n, 0) as n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(replace(t, '!', '')) as n_bangs
      from w left join cov using (rid)),
r as (select *, {", ".join(f"{e} as {k}" for k, e in _PAIRS.items())}, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from c),
good as (select r.* from r where not base_failed and doc_id in (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1)),
vals as (unpivot (select stratum, {", ".join(_PAIRS)} from good) on {", ".join(_PAIRS)} into name rule value v),
grid(cutoff) as (values {_GRID}),
tried as (select stratum, rule, cutoff, count(*) as n, count(*) filter (v > cutoff) as k from vals, grid group by all),
lev as (select {DELTA} / ({len(RULES)} * count(distinct stratum)) as a from good),
passed as (select stratum, rule, min(cutoff) as cutoff from tried, lev where k < n * {RISK / len(RULES)} and
  (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln({1 - RISK / len(RULES)}))) from (select unnest(range(0, k + 1)) as i)) <= a group by all),
wide as (select stratum, {", ".join(f"max(cutoff) filter (rule = '{k}') as c_{k}" for k in _PAIRS)} from passed group by stratum)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce({k} <= c_{k}, true)" for k in _PAIRS)} as kept,
  concat_ws(',', {", ".join(f"case when {k} > c_{k} then '{k}' end" for k in _PAIRS)}) as rejected_by
from r left join wide using (stratum)
"""
