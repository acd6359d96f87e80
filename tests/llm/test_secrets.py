"""Secrets that are long or stand behind dots."""

import base64
import hashlib

from playtide.llm import secret_scan


def random_text(n, tag):
    raw = b"".join(hashlib.sha256(f"{tag}{i}".encode()).digest() for i in range(n // 32 + 1))
    return base64.b64encode(raw).decode().replace("+", "A").replace("/", "B").replace("=", "")[:n]


def test_long_keys_and_parts_behind_dots(spark, tiny_docs):
    key = random_text(1600, "key")
    jwt = [random_text(n, n) for n in (36, 90, 43)]
    mail = [random_text(22, "a"), random_text(43, "b")]
    rows = [(1, f"begin {key} end"), (2, f"use {'.'.join(jwt)} now"), (3, f"use SG.{'.'.join(mail)} now"), (4, "see www.internationalization.characteristically.org and a.b-c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.train(tiny_docs)
    found = {r.doc_id: [s.match for s in r.found] for r in secret_scan.scan(docs, model).collect()}
    assert found == {1: [key], 2: jwt, 3: mail, 4: []}
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs, model).collect()}
    assert clean[1] == "begin [SECRET] end" and clean[3] == "use SG.[SECRET].[SECRET] now"


def test_cutoff_on_the_other_half(spark, tiny_docs):
    """Most random strings of every alphabet are found, none of the ordinary tokens."""
    model = secret_scan.train(tiny_docs)
    assert model["cut"] >= secret_scan.MIN_MEAN and model["recall"] >= 0.95
    lower = "".join(c for c in random_text(200, "low").lower() if c.isalpha())[:40]
    ordinary = ["getUserNameFilePath_index_value", "characteristically-internationalised", "=" * 40, "-" * 80, "a/b/c/d/e/f/g/h/i/j", "2024-01-01-2024-12-31", "1234567890123456"]
    docs = spark.createDataFrame([(1, f"x {lower} y"), (2, " ; ".join(ordinary))], "doc_id long, text string")
    assert {r.doc_id: [s.match for s in r.found] for r in secret_scan.scan(docs, model).collect()} == {1: [lower], 2: []}
