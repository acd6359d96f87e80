"""Search form of a text: compatibility forms, one sign for each kind of punctuation, folded case and blanks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signs that count as one.
_SINGLE = "‘’‚‛′‵❛❜＇"
_DOUBLE = "“”„‟″‶❝❞〝〞〟＂"
_DASH = "‐‑‒–—―⁃−﹘﹣－"
_OTHER = {"、": ",", "。": ".", "｡": ".", "〜": "~", "…": "...", "・": "·", "･": "·"}
_SIGNS = str.maketrans({**dict.fromkeys(_SINGLE, "'"), **dict.fromkeys(_DOUBLE, '"'), **dict.fromkeys(_DASH, "-"), **_OTHER})


def normalize_text(text: str | None) -> str:
    """The search form; empty for null."""
    return " ".join(unicodedata.normalize("NFKC", text or "").translate(_SIGNS).casefold().split())


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text)


def normalized(text: Column | str) -> Column:
    """``normalize_text`` of a column, in Arrow batches: plain SQL has no compatibility forms."""
    return _normalized(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
