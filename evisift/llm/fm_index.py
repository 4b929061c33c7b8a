"""FM-index over lists of word ids: suffix order, wavelet matrix, sampled positions.

Many patterns are searched at once: one backward step is a handful of array look-ups for all of them.
"""

from __future__ import annotations

import numpy as np

SAMPLE_STEP = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; needs a distinct last symbol per segment to end early."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts per level."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> level) & 1
            before = np.concatenate([[0], np.cumsum(bit == 0)])
            self.levels.append((level, before))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Number of places before ``upto`` that hold ``symbol``, for arrays of both."""
        base = np.zeros(len(symbol), dtype=np.int64)
        for level, before in self.levels:
            one = ((symbol >> level) & 1) == 1
            zeros = before[-1]
            upto = np.where(one, zeros + upto - before[upto], before[upto])
            base = np.where(one, zeros + base - before[base], before[base])
        return upto - base


class FMIndex:
    """Index of segments of positive ids; occurrences never span two segments."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, top: int) -> None:
        segments = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        body = np.ones(int(ends[-1]) + 1, dtype=bool)
        body[ends] = False
        symbols = np.zeros(len(body), dtype=np.int64)
        symbols[body] = ids + segments
        symbols[ends] = np.arange(segments)
        order = suffix_order(symbols)
        plain = np.zeros(len(body), dtype=np.int64)
        plain[body] = ids
        self.last = plain[order - 1]
        self.last[order == 0] = 0
        self.ranks = WaveletMatrix(self.last, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=top + 1))])
        # Rows at a segment's start and at every few places know their place; others step back to one.
        self.sampled = (order % SAMPLE_STEP == 0) | (self.last == 0)
        self.sample_row = np.cumsum(self.sampled) - 1
        self.sample_place = order[self.sampled]
        self.place_of = np.cumsum(body) - 1  # place among the ids without the segment ends
        self.size = len(body)

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.ranks.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern number and place (among the ids) of every occurrence; one row per pattern."""
        alive = np.arange(len(patterns))
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low, high = self._back(symbol, low), self._back(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
            if not len(alive):
                break
        count = high - low
        pattern = np.repeat(alive, count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        place = np.zeros(len(row), dtype=np.int64)
        waiting, steps = np.arange(len(row)), 0
        while len(waiting):
            here = self.sampled[row]
            place[waiting[here]] = self.sample_place[self.sample_row[row[here]]] + steps
            waiting, row = waiting[~here], row[~here]
            row = self._back(self.last[row], row)
            steps += 1
        return pattern, self.place_of[place]
