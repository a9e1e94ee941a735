"""Words and n-grams of a column of texts as numpy arrays, read from Arrow's buffers without a Python loop over words.

Hashes are 64-bit polynomial hashes (over bytes for a word, over words for an n-gram), finished by a mixing step.
They are the same in every task and process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
#: Powers that a worker keeps (8 bytes each); longer texts make their own.
KEPT = 2 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed, up to KEPT of them."""
    have = _powers.get(hex(int(base)))
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0] = 1
        have[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if len(have) <= KEPT:
            _powers[hex(int(base))] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, a bijection."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def white_space_words() -> np.ndarray:
    """Byte classes of words [^\\x20\\x09-\\x0D]+."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


@dataclass
class Words:
    """Words of a slice of texts: byte spans in data, the row of each word, and per row the first word's index (n+1 entries)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(texts: pa.LargeStringArray, word: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    """word: which of the 256 byte values belong to words. lower: A-Z hash as a-z."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
    offsets = offsets - (offsets[0] if n else 0)
    inside = word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    ends[cut] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets) if n else np.zeros(1, np.int64)
    row = np.repeat(np.arange(n), np.diff(first))
    h = np.empty(0, np.uint64)
    if hashed:
        table = _BYTE.copy()
        if lower:
            table[65:91] = table[97:123]
        with np.errstate(over="ignore"):
            run = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * _power(_B, len(data)), out=run[1:])
            h = mix((run[end] - run[start]) * _power(_B_INV, len(data) + 1)[start])
    return Words(data, start, end, row, first, h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (len(h) - k + 1 of them, none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(_B, len(h)), out=run[1:])
        return mix((run[k:] - run[:-k]) * _power(_B_INV, n) + np.uint64(k))
