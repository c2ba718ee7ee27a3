"""FM-index over integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions.

All patterns are searched at once: every step is a vector operation.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by prefix doubling; a suffix that ends first comes first."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """rank and access over a sequence of integers below sigma."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, a: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each a occurs before each position i."""
        start, i = np.zeros(len(i), np.int64), i.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (a >> (self.levels - 1 - k)) & 1 == 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i and how often it occurs before i."""
        start, i, a = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] > ones[i]
            a = a * 2 + bit
            start = np.where(bit, zeros + ones[start], start - ones[start])
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return a, i - start


class FMIndex:
    """Index of a sequence of symbols 1..sigma-1, with 0 between passages."""

    def __init__(self, s: np.ndarray, sigma: int, rate: int = 16):
        s = np.append(s.astype(np.int64) + 1, 0)  # 0 ends the text and occurs once
        sigma += 1
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = WaveletMatrix(s[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        marked = order % rate == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.marked = marked
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns, rows padded on the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            at = np.flatnonzero((j < lengths) & (lo < hi))
            a = patterns[at, j] + 1
            lo[at] = self.before[a] + self.bwt.rank(a, lo[at])
            hi[at] = self.before[a] + self.bwt.rank(a, hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each walked back to a sampled one."""
        rows, out, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            done = self.marked[r]
            out[live[done]] = self.samples[self.marks[r[done]]] + steps
            live, r = live[~done], r[~done]
            a, k = self.bwt.access_rank(r)
            rows[live] = self.before[a] + k
            steps += 1
        return out
