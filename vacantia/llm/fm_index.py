"""FM-index over integer text: suffix array, wavelet matrix, backward search, sampled locate.

All steps work on whole numpy arrays, so thousands of patterns advance together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. The last symbol must be the unique smallest one.

    Each round only re-sorts the suffixes whose rank is still shared, so long repeats cost
    rounds over the repeated part alone.
    """
    n = len(text)
    sa = np.argsort(text, kind="stable")
    ordered = text[sa]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # rank = first row of the group
    rank = np.empty(n, np.int64)
    rank[sa] = start
    width = 1
    while True:
        tail = np.concatenate((head[1:], [True]))
        rows = np.flatnonzero(~(head & tail))
        if not len(rows):
            return sa
        suffix = sa[rows]
        ahead = suffix + width  # in range: a suffix shorter than `width` ends in the unique symbol
        key = rank[suffix] * n + rank[np.minimum(ahead, n - 1)]
        order = np.argsort(key, kind="stable")
        key, suffix = key[order], suffix[order]
        sa[rows] = suffix
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head[rows] = fresh
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        rank[suffix] = rows[first]
        width *= 2


class WaveletMatrix:
    """Rank structure: one bit plane a level, zeros stably before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []  # ones before each position
        self.zeros: list[int] = []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(now) - int(before[-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        start, end = np.zeros_like(end), end.copy()
        for depth in range(self.bits):
            ones, bit = self.ones[depth], (symbol >> (self.bits - 1 - depth)) & 1 == 1
            one_start, one_end = ones[start], ones[end]
            start = np.where(bit, self.zeros[depth] + one_start, start - one_start)
            end = np.where(bit, self.zeros[depth] + one_end, end - one_end)
        return end - start


class FMIndex:
    """Index of one shard. ``text`` holds symbols of 1 and more; 0 is appended as its end."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate((text, [0])).astype(np.int64)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        counts = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))  # C: symbols smaller than each one
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.sampled = sa[self.marked]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (one a row): pattern numbers and row ranges that occur."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            low, high = self._step(symbol, low), self._step(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled suffix."""
        out, todo, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            there = self.marked[row]
            out[todo[there]] = self.sampled[self.mark_rank[row[there]]] + steps
            todo, row = todo[~there], row[~there]
            row = self._step(self.bwt[row], row)
            steps += 1
        return out
