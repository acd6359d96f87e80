"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from playtide.llm import spelling_variants as sv


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=2):
    by = {}
    for w, n in counts.items():
        around = [(-m, x) for x, m in counts.items() if near(w, x)]
        form = min(around)[1] if around and -min(around)[0] >= factor * n else None
        by[w] = (form, n, len(around), counts[form] if form else None)
    root = lambda w: w if by[w][0] is None else root(by[w][0])
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in by.items()}


@pytest.mark.parametrize("bits", [64, sv.FILTER_BITS])
def test_against_brute_force(spark, bits):
    """A full bitmap lets every member through to the join; the result is the same."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(150)} | {"aaaaa", "aaaaaa", "aaaaab", "aaaa", "x" * 3000, "x" * 3001, "x" * 2999 + "y", "漢字かな文", "漢字かな", "ñandúes"}
    counts = {w: rng.choice([1, 2, 3, 5, 8, 20, 41, 100]) for w in words}
    vocab = sv.materialize(spark.createDataFrame(list(counts.items()), "word string, n long"))
    pairs = {(r.word, r.near) for r in sv.near_words(vocab, bits).collect()}
    assert pairs == {(a, b) for a in words for b in words if near(a, b)}
    assert sv.near_words(vocab, bits).count() == len(pairs)
    assert {tuple(r) for r in sv.variant_groups(vocab).collect()} == brute(counts)


@pytest.mark.parametrize("word", ["abcde", "aabbc", "aaaaa", "é", "ab"])
def test_whole_neighbourhood_once(word):
    """With every place of the bitmap set, all members come, each once."""
    letters = np.array(sorted({*map(ord, "abcé")}), np.uint32)
    codes = np.array([[ord(c) for c in word]], np.uint32)
    got = [word[:at] + (chr(c) if c >= 0 else "") + word[end:] for _, at, end, c in sv.neighbourhood(codes, letters, np.full(8, 255, np.uint8))]
    n = len(word)
    want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in "abcé"} | {word[:i] + c + word[i:] for i in range(n + 1) for c in "abcé"}
    assert len(got) == len(set(got)) and set(got) == want - {word}


def test_vocabulary_of_odd_texts(odd_docs):
    got = {r.word: r.n for r in sv.vocabulary(odd_docs, "doc_id", sv.misspelt, 3, 1).collect()}
    want = Counter()
    for r in odd_docs.collect():
        doc = "" if r.doc_id is None else str(r.doc_id)
        want.update(sv.misspelt(doc, w) for w in re.findall("[a-z\xc0-\xff]{3,}", (r.text or "").encode().lower().decode()))
    assert got == {w: n for w, n in want.items() if len(w) >= 3}


def test_empty_table(odd_docs):
    assert sv.variant_groups(sv.vocabulary(odd_docs.limit(0), "doc_id")).count() == 0


def test_long_chain_of_forms(spark):
    """Each form is twice as frequent; the root is the last, past the first doubling."""
    words = ["a" * (5 + k) for k in range(20)]
    vocab = sv.materialize(spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(words)], "word string, n long"))
    assert {r.root for r in sv.variant_groups(vocab).collect()} == {words[-1]}
