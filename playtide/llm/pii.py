"""Personal data by candidate gradient boosting (DataFrame functions only on the rows).

Fixed patterns give the base spans.  Wider generators propose further spans, which may
overlap: spelled-out e-mail addresses, national phone formats, card numbers inside
longer rows of digit groups, dotted numbers.  They propose local parts of up to 64 characters, up to five labels of up to
63, and cards of 16 (by fours) or 15 digits (4-6-5); other forms are left to the base
patterns.  Boosted trees score each candidate by its format
and its context, and a threshold for each kind decides, calibrated on a third of the
training sample that the trees have not seen: the lowest score at and above which an exact
binomial bound shows a precision of ``PRECISION`` but for a chance of ``DOUBT`` (equal scores
fall on one side).  The precision beyond it is
measured on the last third; a kind for which nothing can be shown adds no spans (with these
lines, dotted numbers: addresses and versions look alike).  Cards must pass Luhn's check.  Accepted candidates
are taken best first, and one that overlaps a taken one goes; base spans always stay and are never overlapped.

The trees are fitted on the driver to ``FIT_ROWS`` labelled lines written by a seeded
rule (formats of personal data, and look-alikes such as order numbers, versions, dates
and measurements); their features come from the same expressions as those of the
documents.  The fitted trees become nested CASE expressions.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.llm.spans import SPAN, best_apart, count_of, distinct_spans, find_spans, free_of, named

KINDS = ["email", "ip", "card", "phone"]
FIT_ROWS, TREES, RATE, PRECISION, DOUBT = 6000, 24, 0.3, 0.95, 0.05
#: Places of a leaf's value, the same in calibration and in the scan.
LEAF_PLACES = 5
# possessive forms of the base patterns: linear time, and the same matches, because what
# follows each run cannot start with a character of the run; a run is entered at its
# start or where the last match ended
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: High-recall generators: kind, pattern, trigger.
WIDE = [
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]{1,63}){1,4}", r"(?i)@|[(\[]at[)\]]"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"[0-9]\.[0-9]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])", r"[0-9]{4}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])", r"[0-9]{3}"),
]
#: Characters behind a match that a later start may need; the longest match, an e-mail address, has 413.
REACH = 420
#: Words near personal data, by kind.
CONTEXT = {
    "email": "mail|contact|write|reach|e-mail|address",
    "ip": "ip|host|server|login|address|client|from",
    "card": "card|visa|credit|master|amex|pay",
    "phone": "phone|call|tel|mobile|fax|contact|reach|dial",
}
AGAINST = "version|order|invoice|ref|build|serial|section|isbn|part|total|id|ticket|release|model|qty"
FEATURES = ["digits", "length", "seps", "parens", "at_word", "at_sign", "dot_word", "luhn", "octets", "near", "against", "left_word", "right_word", "distinct", *KINDS]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """The digits pass Luhn's check."""
    d = F.split(F.reverse(_digits(m)), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    size = lambda m: F.length(_digits(m))
    return F.sort_array(
        F.concat(
            find_spans(text, EMAIL, "email", 0, text.contains("@")),
            find_spans(text, IP, "ip", 1, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
            find_spans(text, CARD, "card", 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda m: size(m).between(14, 19) & luhn(m)),
            find_spans(text, PHONE, "phone", 3, text.rlike(r"\+[0-9]"), lambda m: size(m).between(10, 15)),
        )
    )


def candidates(text: Column) -> Column:
    """Spans that the generators propose, overlapping ones included.

    Every start is tried: those inside a match by themselves, so a false start hides nothing.
    """
    out = []
    for k, p, t in WIDE:
        rank = KINDS.index(k)
        first = find_spans(text, p, k, rank, text.rlike(t))
        out += [first, _inner(text, p, k, rank, first)]
    return F.filter(distinct_spans(F.concat(*out)), lambda s: (s["rank"] != KINDS.index("card")) | luhn(s["match"]))


def _inner(text: Column, pattern: str, kind: str, rank: int, found: Column) -> Column:
    """Matches of ``pattern`` that start inside a match of ``found``, from every start."""

    def starts(s: Column) -> Column:
        # each start is seen with the character before it, for the lookbehind
        room = F.substring(text, s["start"] + 1, (s["end"] - s["start"]) + REACH)

        def at(i: Column) -> Column:
            hit = F.regexp_extract(F.substring(room, i, F.length(room)), rf"^(?s:.)({pattern})", 1)
            begin = s["start"] + i
            return F.struct(begin.cast("int").alias("start"), F.lit(rank).alias("rank"), (begin + F.length(hit)).cast("int").alias("end"), F.lit(kind).alias("kind"), hit.alias("match"))

        return F.filter(F.transform(F.sequence(F.lit(1), F.length(s["match"]) - 1), at), lambda x: x["match"] != "")

    return F.flatten(F.transform(found, starts)).cast(SPAN)


def features(text: Column, s: Column) -> Column:
    """Struct of doubles, by ``FEATURES``."""
    m, low = s["match"], F.lower(F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30))))
    before, after = F.substring(text, s["start"], F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))
    near = F.lit(False)
    for i, k in enumerate(KINDS):
        near = near | ((s["rank"] == i) & low.rlike(CONTEXT[k]))
    values = {
        "digits": F.length(_digits(m)),
        "length": F.length(m),
        "seps": F.length(F.regexp_replace(m, r"[^\x20.-]", "")),
        "parens": m.contains("("),
        "at_word": m.rlike(r"(?i)[(\[]at[)\]]"),
        "at_sign": m.contains("@"),
        "dot_word": m.rlike(r"(?i)[(\[]dot[)\]]"),
        "luhn": luhn(m),
        "octets": m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "near": near,
        "against": low.rlike(AGAINST),
        "left_word": (s["start"] > 0) & before.rlike(r"[A-Za-z0-9.#/=]"),
        "right_word": after.rlike(r"[A-Za-z0-9#/=%]"),
        "distinct": F.size(F.array_distinct(F.split(_digits(m), ""))),
    } | {k: s["rank"] == i for i, k in enumerate(KINDS)}
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def training_lines(rows: int = FIT_ROWS, seed: int = 11) -> list[tuple[str, str, int, int]]:
    """(text, kind, start, end): lines with one item of personal data; an empty kind where it only looks like one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfglmnprst") for i in range(r.randint(3, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def checked(n: int, good: bool) -> str:
        d = r.choice("3456") + num(n - 2)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d)))
        last = (-total) % 10
        return d + str(last if good else (last + r.randint(1, 9)) % 10)

    def grouped(d: str) -> str:
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(4)} {num(4)}"])

    def address() -> str:
        return f"{word()}.{word()}{r.choice([' (at) ', ' [at] ', '(at)', '[at]'])}{word()}{r.choice([' (dot) ', ' [dot] ', '.'])}{r.choice(['com', 'org', 'net'])}"

    octets = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    good = [("phone", "phone", phone), ("email", "email", address), ("card", "card", lambda: grouped(checked(16, True))), ("ip", "ip", octets)]
    bad = [
        lambda: grouped(checked(16, False)), lambda: f"{num(3)}.{r.randint(256, 999)}.{num(2)}.{num(2)}", lambda: f"{num(3)} {num(3)} {num(4)}",
        lambda: f"{word()}@{word()} . {word()}", lambda: octets(), phone, lambda: f"{num(4)}-{num(4)}-{num(4)}",
    ]
    out = []
    for _ in range(rows):
        left = " ".join(word() for _ in range(r.randint(0, 6)))
        if r.random() < 0.5:
            kind, theme, make = r.choice(good)
            hint = r.choice(CONTEXT[theme].split("|")) + r.choice([": ", " ", " is ", " at "])
            text = f"{left} {hint}"
        else:
            kind, make = "", r.choice(bad)
            text = f"{left} " + (r.choice(AGAINST.split("|")) + r.choice([" ", ": ", " no. ", "#"]) if r.random() < 0.7 else "")
        item = make()
        out.append((f"{text}{item} {word()}", kind, len(text), len(text) + len(item)))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """Regression tree on gradients: (feature, cut, left, right) or a leaf value."""
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return (value,)
    best = (1e-3, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")):
            left = x[:, f] <= c
            if 8 <= left.sum() <= len(left) - 8:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, f, float(c))
    if best[1] is None:
        return (value,)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _leaf(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), round(tree[0], LEAF_PLACES))
    return np.where(x[:, tree[0]] <= tree[1], _leaf(tree[2], x), _leaf(tree[3], x))


def _case(tree: tuple, f: Column) -> Column:
    if len(tree) == 1:
        return F.lit(round(tree[0], LEAF_PLACES))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _case(tree[2], f)).otherwise(_case(tree[3], f))


def at_least(k: int, n: int, p: float) -> float:
    """Probability of ``k`` or more of ``n`` at a rate of ``p``."""
    one = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))
    return sum(one(i) for i in range(k, n + 1))


def cutoff(score: np.ndarray, y: np.ndarray, precision: float, doubt: float) -> float:
    """The lowest score at and above which the share of ``y`` exceeds ``precision``, by the exact bound; infinity without one.

    Equal scores go together.  Scores are tested from the highest down to the first that fails, so all tests share ``doubt``.
    """
    values, place = np.unique(np.round(score, 9), return_inverse=True)
    taken = np.bincount(place, minlength=len(values))[::-1].cumsum()
    right = np.bincount(place, weights=y, minlength=len(values))[::-1].cumsum()
    cut = float("inf")
    for v, n, k in zip(values[::-1].tolist(), taken.tolist(), right.tolist(), strict=True):
        if precision**n > doubt:
            continue  # too few to show anything
        if at_least(int(k), n, precision) > doubt:
            break
        cut = v - 1e-9
    return cut


def train(spark: SparkSession, rows: int = FIT_ROWS) -> dict:
    """Boosted trees, a threshold for each kind and its precision on lines seen by neither, from the labelled lines."""
    lines = spark.createDataFrame([(i, *x) for i, x in enumerate(training_lines(rows))], "n int, text string, truth string, a int, b int")
    cands = lines.withColumn("s", F.explode(candidates(F.col("text"))))
    label = (F.col("s.kind") == F.col("truth")) & (F.col("s.start") < F.col("b")) & (F.col("s.end") > F.col("a"))
    got = cands.select("n", F.col("s.rank").alias("rank"), label.cast("int").alias("y"), features(F.col("text"), F.col("s")).alias("f")).orderBy("n", "s.start", "rank").collect()
    x = np.array([list(r["f"]) for r in got])
    y, rank, fold = np.array([r["y"] for r in got], float), np.array([r["rank"] for r in got]), np.array([r["n"] % 3 for r in got])
    fit = fold == 0
    bias = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    total, trees = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x[fit], (y - p)[fit], (p * (1 - p))[fit], 3)
        trees.append(tree)
        total += RATE * _leaf(tree, x)
    cuts, precision = {}, {}
    for i, kind in enumerate(KINDS):
        own = rank == i
        cuts[kind] = cutoff(total[own & (fold == 1)], y[own & (fold == 1)], PRECISION, DOUBT)
        taken = own & (fold == 2) & (total >= cuts[kind])
        precision[kind] = float(y[taken].mean()) if taken.any() else None
    return {"bias": bias, "trees": trees, "cuts": cuts, "precision": precision}


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text, base and found: spans of the patterns, and all spans with the accepted candidates."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = body.select("doc_id", "text", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("wide"))
    free = based.withColumn("wide", free_of(F.col("wide"), F.col("base")))
    described = free.withColumn("f", F.transform("wide", lambda s: features(F.col("text"), s)))

    def score(f: Column) -> Column:
        total = F.lit(model["bias"])
        for t in model["trees"]:
            total = total + RATE * _case(t, f)
        return total

    scored = described.withColumn("p", F.transform("f", score))
    cut = lambda s: F.when(s["rank"] == 0, model["cuts"]["email"]).when(s["rank"] == 1, model["cuts"]["ip"]).when(s["rank"] == 2, model["cuts"]["card"]).otherwise(model["cuts"]["phone"])
    accepted = scored.withColumn(
        "wide",
        F.filter(F.transform("wide", lambda s, i: F.struct(F.get("p", i).alias("p"), s.alias("s"))), lambda w: w["p"] >= cut(w["s"])),
    )
    # best first; only spans that stay drop others
    added = best_apart(F.col("wide"))
    return accepted.select("doc_id", "text", "base", F.sort_array(F.concat("base", added)).alias("found"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark))
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("found")).alias("spans"),
    )
