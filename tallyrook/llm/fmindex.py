"""FM-index over word ids: suffix order, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling.  Zeros are
    separators, each different from all others and smaller than any word; the
    last symbol must be one."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    separators = np.flatnonzero(rank == 0)
    rank += len(separators)
    rank[separators] = np.arange(len(separators))
    key, step = rank, 0
    while True:
        order = np.argsort(key)
        changed = np.zeros(n, np.int64)
        changed[1:] = key[order[1:]] != key[order[:-1]]
        dense = np.cumsum(changed)
        if n == 0 or dense[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = dense
        step = max(1, 2 * step)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after


class FMIndex:
    """Index of `symbols` (0: separator; 1..sigma: words).  A match never spans
    a separator."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        symbols = np.asarray(symbols, np.int32)
        if not len(symbols) or symbols[-1] != 0:
            symbols = np.append(symbols, np.int32(0))
        self.n, self.sigma = len(symbols), sigma
        order = suffix_array(symbols)
        before = symbols[order - 1]
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.cumsum(counts) - counts
        # a position is sampled every SAMPLE symbols and after each separator,
        # so a walk backwards from a match meets a sample before a separator
        run_start = np.ones(self.n, bool)
        run_start[1:] = symbols[:-1] == 0
        sampled = run_start | (np.arange(self.n) % SAMPLE == 0)
        marked = sampled[order]
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.positions = order[marked]
        # wavelet matrix: per level the running count of ones, then a stable
        # partition by that level's bit
        self.levels, self.zeros = [], []
        now = before
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (now >> bit) & 1
            running = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=running[1:])
            self.levels.append((bit, running))
            self.zeros.append(self.n - int(running[-1]))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        self.begin = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bit, running), zeros in zip(self.levels, self.zeros, strict=True):
            ones = running[i]
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands among the first i of the transform."""
        return self._down(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at row i of the transform, and its rank there."""
        c = np.zeros(len(i), np.int64)
        for (bit, running), zeros in zip(self.levels, self.zeros, strict=True):
            ones = running[i]
            one = running[i + 1] > ones
            c |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.begin[c]

    def search(self, phrases: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each phrase phrases[offsets[k]:offsets[k + 1]],
        read backwards; low == high where it doesn't occur."""
        n = len(offsets) - 1
        low, high = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        left = np.diff(offsets)
        high[left == 0] = 0
        live = np.flatnonzero(left > 0)
        step = 0
        while len(live):
            step += 1
            c = phrases[offsets[live + 1] - step].astype(np.int64)
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[(high[live] > low[live]) & (left[live] > step)]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to the nearest sample."""
        out = np.zeros(len(rows), np.int64)
        live, row, steps = np.arange(len(rows)), np.asarray(rows, np.int64), 0
        while len(live):
            done = self.marked[row]
            out[live[done]] = self.positions[self.mark_rank[row[done]]] + steps
            live, row = live[~done], row[~done]
            if len(live):
                c, r = self.access(row)
                row = self.first[c] + r
                steps += 1
        return out
