"""FM-index over integer sequences: suffix array, wavelet-matrix ranks, sampled positions. Pure numpy, used inside tasks."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling that sorts again only the suffixes that are still tied. ``seq`` ends with its unique least symbol."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    new = np.concatenate(([True], seq[sa[1:]] != seq[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        own = sa[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n - 1)]
        order = np.argsort(key, kind="stable")
        sa[at] = own[order]
        key = key[order]
        differs = np.concatenate(([True], key[1:] != key[:-1]))
        new[at] = differs
        rank[sa[at]] = at[np.maximum.accumulate(np.where(differs, np.arange(len(at)), 0))]
        step *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, rate: int = 8):
        """``seq``: symbols 1..sigma-1, then one 0. Every ``rate``-th text position is kept."""
        self.n = n = len(seq)
        sa = suffix_array(seq)
        cur = seq[sa - 1].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        marked = sa % rate == 0
        self.marks = np.zeros(n + 1, np.int32)
        np.cumsum(marked, out=self.marks[1:])
        self.sample = sa[marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``upto`` places of the transform."""
        low, high = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one place to the left."""
        low, at, symbol = np.zeros_like(row), row, np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol * 2 + bit
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return self.first[symbol] + at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (one a row, equal lengths) at once: first row, past-the-end row."""
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pattern, and the text position, of each occurrence."""
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]
        position = np.full(len(row), -1, np.int64)
        open_, steps = np.arange(len(row)), 0
        while len(open_):
            marked = self.marks[row + 1] > self.marks[row]
            position[open_[marked]] = self.sample[self.marks[row[marked]]] + steps
            open_, row = open_[~marked], self.step(row[~marked])
            steps += 1
        return which, position
