import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, component_id long"


def words(rng, n):
    return " ".join("".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, very long and single-word texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    base = words(rng, 80)
    rows = [
        (1, None, None, None, None, "x", None, None), (2, "", "en", "a", 0, None, "y", 7), (3, " \n\t ", None, "a", 3, None, None, None), (4, "one", "en", None, 3, None, None, 1),
        (5, base, "en", "a", 1, "k", "r", 2), (6, base, None, "b", 1, None, None, 2), (7, base.replace(" ", "\n", 3), "fr", "b", 1, None, None, 2), (8, words(rng, 30000), "en", "c", 9, None, None, None),
        (9, "same " * 5000, "de", "c", 9, None, None, None), (5, base, "en", "a", 1, "k", "r", 2), (None, base, "en", "a", 1, None, None, None), (None, None, None, None, None, None, None, None),
        (10, "é ß ñ 漢字 \U0001f600 " * 20, "fr", "d", 5, None, None, None), (11, "[x] (y) $1 \\d+ " * 5, "es", "d", 5, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def tiny_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
