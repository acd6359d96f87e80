"""Packing: very long white space, whole rests, and the linear program."""

import random
import zlib

import numpy as np
import pytest

from playtide.llm import packing


@pytest.mark.parametrize("text", [" " * 1_500_000 + "x", "\n" * 1_500_000, "ab" * 20_000, "<|endoftext|> " * 3, "é漢 \U0001f600\t\r\n  x" * 50])
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder()(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000 + "x"), (2, "one two")], "doc_id long, text string")
    got = packing.pack(packing.materialize(packing.pieces(docs))).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    assert got[got.doc_id == 1].doc_tokens.min() >= 1_500_000 and got[got.doc_id == 2].doc_tokens.tolist() == [3]


def test_only_full_pieces_and_a_rest():
    ids = np.arange(2500, dtype=np.uint32)
    assert packing.cut(ids) == [(s, n, zlib.crc32(ids[s : s + n].astype("<u4").tobytes())) for s, n in ((0, 1024), (1024, 1024), (2048, 452))]


def test_program_on_triplets():
    """Lengths between a quarter and a half that fill sequences by threes only."""
    rng = random.Random(4)
    h: dict[int, int] = {}
    for _ in range(60):
        a = rng.randint(260, 400)
        b = rng.randint(260, 1024 - a - 260)
        for s in (a, b, 1024 - a - b):
            h[s] = h.get(s, 0) + 50
    plan = packing.patterns_for(h)
    assert all(sum(s * n for s, n in p.items()) <= 1024 for p, _ in plan)
    used = {s: sum(p.get(s, 0) * t for p, t in plan) for s in h}
    assert used == h
    assert sum(t for _, t in plan) <= 1.02 * 60 * 50


def test_a_program_without_full_patterns():
    """Two of 600 never fit one sequence: the bound by the duals ends the program, not the total length."""
    assert sum(t for _, t in packing.patterns_for({600: 1000, 500: 300})) == 1150
