"""Distinct words of Arrow slices and the ids a worker remembers for them, without a Python object a token."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from . import textbytes as B

#: Longer words are named by XXH3 instead of a sum of powers.
LONG = 64


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word's bytes."""
    far = np.flatnonzero(ends - starts > LONG)
    h = B.span_hashes(data, starts, np.minimum(ends, starts + LONG) if len(far) else ends)
    for i in far.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all pairs, one after the other."""
    if not len(size):
        return flat[:0]
    upto = np.cumsum(size, dtype=np.int64)
    at = np.arange(upto[-1])
    at += np.repeat(start - (upto - size), size)
    return flat[at]


class Numbers:
    """Numbers 0, 1, .. of up to `most` distinct keys (evenly spread 64-bit numbers) by open addressing."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most).bit_length())
        self.table, self.keys, self.n = np.full(1 << self.bits, -1, np.int32), np.zeros(most + 1, np.uint64), 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot, mask = self._slot(h), (1 << self.bits) - 1
        at = self.table[slot]
        todo = np.flatnonzero((at >= 0) & (self.keys[at] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            got = at[todo] = self.table[slot[todo]]
            todo = todo[(got >= 0) & (self.keys[got] != h[todo])]
        return at

    def add(self, h: np.ndarray) -> np.ndarray:
        """Numbers of distinct keys that aren't there yet."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.keys[number] = h
        self.n += len(h)
        slot, mask, left = self._slot(h), (1 << self.bits) - 1, np.arange(len(h))
        while len(left):
            free = self.table[slot[left]] < 0
            tried = left[free]
            self.table[slot[tried]] = number[tried]
            left = np.concatenate((left[~free], tried[self.table[slot[tried]] != number[tried]]))
            slot[left] = (slot[left] + 1) & mask
        return number


class WordMemory:
    """Ids by word name; starts afresh when it holds `most_words` or `most_ids`. Results don't depend on what is remembered."""

    def __init__(self, most_words: int = 1 << 20, most_ids: int = 1 << 23):
        self.most_words, self.most_ids = most_words, most_ids
        self.clear()

    def clear(self) -> None:
        self.names, self.used = Numbers(self.most_words), 0
        self.start = np.zeros(self.most_words, np.int32)
        self.size = np.zeros(self.most_words, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct names that aren't there yet, with their ids in a row."""
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used // 2 + total, np.int32)))
        self.flat[self.used : self.used + total] = ids
        number = self.names.add(h)
        self.size[number], self.start[number] = size, self.used + np.cumsum(size) - size
        self.used += total

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, work: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each row's ids begin (rows + 1); first[r] is row r's first word.

        work(distinct words) takes those that aren't remembered and gives the order it took, ids in a row, and how many each has.
        """
        parts, sizes = [], np.zeros(len(starts) + 1, np.int64)
        step = min(self.most_words, 1 << 18)
        for a in range(0, len(starts), step):
            s, e = starts[a : a + step], ends[a : a + step]
            h = names(data, s, e)
            at = self.names.find(h)
            if (at < 0).any():
                miss = np.flatnonzero(at < 0)
                fresh, where = np.unique(h[miss], return_index=True)
                if self.used > self.most_ids or self.names.n + len(fresh) > self.most_words:
                    self.clear()
                    at[:], miss = -1, np.arange(len(h))
                    fresh, where = np.unique(h, return_index=True)
                lo, hi = s[miss[where]].tolist(), e[miss[where]].tolist()
                order, ids, size = work([data[i:j].tobytes().decode() for i, j in zip(lo, hi)])
                self.add(fresh[order], ids, size)
                at[miss] = self.names.find(h[miss])
            sizes[a + 1 : a + 1 + len(s)] = self.size[at]
            parts.append(ragged(self.flat, self.start[at], self.size[at]))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.cumsum(sizes)[first]
