"""Token ids of texts by way of their words: each different word is encoded once per worker, texts are put together with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

#: Words that a worker keeps before it starts anew; bounds its memory.
MOST_WORDS = 1_000_000


_kept: dict = {}


def kept(key, make: Callable[[], object]):
    """What make gives, kept by the worker for its next tasks: the few compiled models and bounded caches of words that texts share."""
    if key not in _kept:
        if len(_kept) >= 4:
            _kept.clear()
        _kept[key] = make()
    return _kept[key]


class WordCache:
    def __init__(self, encode_many: Callable[[list], Iterable[list[int]]], most: int = MOST_WORDS):
        self.encode_many, self.most = encode_many, most
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0

    def learn(self, words: list) -> None:
        if len(self.index) + len(words) > self.most and self.index:
            raise OverflowError
        got = list(self.encode_many(words))
        first, n = len(self.index), len(words)
        self.index.update(zip(words, range(first, first + n), strict=True))
        while len(self.start) < first + n:
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        sizes = np.fromiter(map(len, got), np.int64, n)
        total = int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, self.flat])
        if n:
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.size[first : first + n] = sizes
            self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, words: list, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are given as one list of words, counts[k] of them in text k; and the texts' bounds in the ids."""
        found = list(map(self.index.get, words))
        if None in found:
            missing = [k for k, x in enumerate(found) if x is None]
            try:
                self.learn(list({words[k] for k in missing}))
                for k in missing:
                    found[k] = self.index[words[k]]
            except OverflowError:
                self.clear()
                self.learn(list(set(words)))
                found = list(map(self.index.get, words))
        at = np.array(found, np.int64)
        size, start = self.size[at], self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
