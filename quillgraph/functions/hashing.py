"""MinHash signatures with fixed constants."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

HASHES, BANDS = 32, 16
ROWS = HASHES // BANDS
MASK = 0xFFFFFFFF

# The seed and steps of the generator that makes the constants.
SEED, STEP = 0x3777AAA1, 0x6D2B79F5
OFFSET, PRIME = 0x811C9DC5, 0x01000193


def _constants() -> list[tuple[int, int]]:
    """(odd multiplier, addend) for each hash, from a small 32-bit generator (mulberry32)."""
    state, drawn = SEED, []
    for _ in range(2 * HASHES):
        state = (state + STEP) & MASK
        t = ((state ^ (state >> 15)) * (state | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        drawn.append(int(((t ^ (t >> 14)) / 2**32) * MASK))
    return [(a | 1, b) for a, b in zip(drawn[::2], drawn[1::2], strict=True)]


CONSTANTS = _constants()


@functools.lru_cache(1 << 18)
def fnv1a(word: str) -> int:
    """32-bit FNV-1a over the word's UTF-16 units."""
    raw = word.encode("utf-16-le", "surrogatepass")
    h = OFFSET
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * PRIME & MASK
    return h


FACTORS, ADDENDS = (np.array([c[i] for c in CONSTANTS], np.uint64)[:, None] for i in (0, 1))


def signature(words: Iterable[str]) -> list[int]:
    """The least of (a * h + b) mod 2^32 over the words' hashes, for each pair of constants; all ones without words."""
    h = np.array([fnv1a(w) for w in words], np.uint64)
    return ((FACTORS * h + ADDENDS) & np.uint64(MASK)).min(axis=1).tolist() if len(h) else [MASK] * HASHES


def bands(sig: Column | str) -> Column:
    """An array of one key for each band of a signature."""
    sig = col(sig)
    parts = [[F.get(sig, F.lit(band * ROWS + r)).cast("string") for r in range(ROWS)] for band in range(BANDS)]
    return F.array(*[F.concat_ws(":", F.lit(str(band)), *p) for band, p in enumerate(parts)])


def estimate(a: Column | str, b: Column | str) -> Column:
    """The share of equal slots."""
    same = F.zip_with(col(a), col(b), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / HASHES
