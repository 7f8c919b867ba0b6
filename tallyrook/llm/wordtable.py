"""Ids of words, remembered in flat arrays and looked up for all words at once.

A word is a span of bytes with a variant number (0 unless the caller tells
words of the same bytes apart).  Its 64-bit hash finds its entry in an open
hash table, the entry its ids in one array; ids of a text are gathered, with no
Python object per word.  Words above LONG bytes and words of rare tables are
not remembered, so memory is bounded by bytes: the table starts anew at WORDS
entries or IDS ids, some 80 MB.  Equal words are told by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tallyrook.llm import textvec

WORDS, IDS = 1 << 20, 1 << 22
#: Words above so many bytes are encoded anew each time.
LONG = 256
#: Words that are learned together.
BATCH = 20_000
_VARIANT = np.uint64(0xA24BAED4963EE407)

#: Of some words, (bytes, variant): their order in what follows, their ids one
#: after another, how many each has.
Learner = Callable[[list[tuple[bytes, int]]], tuple[list[int], np.ndarray, np.ndarray]]


class WordTable:
    def __init__(self, learn: Learner):
        self.learn = learn
        self._clear(1 << 12)

    def _clear(self, slots: int) -> None:
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)  # key 0: free
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0
        self.begin, self.size, self.n = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        at = h & mask
        found = self.keys.take(at)
        out = np.where(found == h, self.entry.take(at), np.int32(-1))
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            found = self.keys.take(at[left])
            hit = found == h[left]
            out[left[hit]] = self.entry.take(at[left[hit]])
            left = left[~hit & (found != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Enter new, different hashes."""
        mask = np.uint64(len(self.keys) - 1)
        at, left = h & mask, np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.entry[at[put]] = h[put], entry[put]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + np.uint64(1)) & mask

    def _remember(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        while self.n + len(h) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.begin[entry], self.size[entry] = self.n_ids + np.cumsum(size) - size, size
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + len(h), self.n_ids + len(flat)
        if 2 * self.n > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, entries = self.keys[old], self.entry[old]
            slots = 1 << int(3 * self.n).bit_length()
            self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._place(keys, entries)
        self._place(h, entry)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, variant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        none = np.zeros(0, np.uint32)
        if not len(starts):
            return none, np.zeros(0, np.int64)
        h = textvec.span_hashes(data, starts, ends)
        if variant is not None:
            h ^= variant.astype(np.uint64) * _VARIANT
        h[h == 0] = 1
        if self.n > WORDS or self.n_ids > IDS:
            self._clear(1 << 12)

        def words(which: np.ndarray) -> list[tuple[bytes, int]]:
            v = [0] * len(which) if variant is None else variant[which].tolist()
            return [(data[a:b].tobytes(), k) for a, b, k in zip(starts[which].tolist(), ends[which].tolist(), v, strict=True)]

        long_ = np.flatnonzero(ends - starts > LONG)
        entry = self._find(h)
        entry[long_] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            todo = new[np.sort(first)]
            for k in range(0, len(todo), BATCH):
                some = todo[k : k + BATCH]
                order, flat, size = self.learn(words(some))
                self._remember(h[some[order]], flat, size)
            entry[new] = self._find(h[new])
        size = self.size.take(entry).astype(np.int64)
        begin = self.begin.take(entry).astype(np.int64)
        extra = []
        for k in long_.tolist():
            _, ids, _ = self.learn(words(np.array([k])))
            extra.append((k, ids))
            size[k], begin[k] = len(ids), 0
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size)
        at += np.arange(len(at))
        for k, _ in extra:
            at[stop[k] - size[k] : stop[k]] = 0
        out = self.ids.take(at)
        for k, ids in extra:
            out[stop[k] - size[k] : stop[k]] = ids
        return out, size
