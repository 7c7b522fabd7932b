"""Word shingles of texts as sets of 52-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import LOWER, mix, span_hashes, steps, window_hashes, words

BITS = 52
#: Texts of a step at most, for which the other 12 bits of a word are enough.
STEP_ROWS = 1 << (64 - BITS)


def shingle_steps(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in steps(ends):
        for c in range(a, b, STEP_ROWS):
            yield c, min(b, c + STEP_ROWS)


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and bounds by row of the distinct shingles of at most STEP_ROWS texts, by row and hash.

    A-Z are lower-cased. A text of fewer than `size` words, but one at least, is one shingle.
    """
    n = len(ends) - 1
    data = LOWER[data]
    start, end, row = words(data, ends)
    value = span_hashes(data, start, end)
    counts = np.bincount(row, minlength=n)
    keys = []
    for k in range(1, size + 1):
        got, at = window_hashes(value, row, k)
        if k < size:
            whole = counts[row[at]] == k
            got, at = mix(got[whole] + np.uint64(k)), at[whole]
        keys.append((row[at].astype(np.uint64) << np.uint64(BITS)) | (got >> np.uint64(64 - BITS)))
    key = np.sort(np.concatenate(keys))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key = key[fresh]
    row = (key >> np.uint64(BITS)).astype(np.int64)
    return row, key & np.uint64((1 << BITS) - 1), np.searchsorted(row, np.arange(n + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
