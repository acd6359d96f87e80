"""Vectorised word and shingle hashes over the bytes of a text (used inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Space and 0x09 to 0x0D part words; every other byte belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Outside 0-9, a-z (after lower-casing A-Z) and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(lowered: bytes, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the maximal runs of bytes outside ``gap``."""
    inside = np.zeros(len(lowered) + 2, np.int8)
    inside[1:-1] = ~gap[np.frombuffer(lowered, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: str | None, gap: np.ndarray = SPACE) -> np.ndarray:
    """64-bit hashes of the words of ``text``, A-Z lower-cased; none for null or no words."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if not raw:
        return np.empty(0, _U)
    starts, ends = word_bounds(raw, gap)
    if not len(starts):
        return np.empty(0, _U)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order; of the whole sequence if it is shorter, not empty."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, _U)
    for j in range(width):
        out = mix(out * _U(0x100000001B3) + words[j : j + n - width + 1])
    return out


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` values in order, each by a difference of prefix sums."""
    n = len(values)
    if n < k:
        return values[:0]
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix(values) * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
