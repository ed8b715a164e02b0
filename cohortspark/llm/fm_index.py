"""FM-index over word numbers: suffix order, wavelet matrix of the transform, sampled positions. NumPy, one shard at a time."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """``rank(c, i)``: occurrences of ``c`` before ``i``, for arrays of queries."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin, end = np.zeros_like(i), i
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            up = (c >> level) & 1 == 1
            b1, e1 = self.ones[k][begin], self.ones[k][end]
            begin, end = np.where(up, self.zeros[k] + b1, begin - b1), np.where(up, self.zeros[k] + e1, end - e1)
        return end - begin


class FmIndex:
    """Stretches of symbols >= 2, each followed by a separator (1); 0 ends the whole. A match never spans a separator."""

    def __init__(self, stretches: list[np.ndarray], sample: int = 8):
        parts = [x for s in stretches for x in (s.astype(np.int64), np.ones(1, np.int64))]
        text = np.concatenate([*parts, np.zeros(1, np.int64)])
        cut = np.flatnonzero(text == 1)
        apart = text + len(cut)  # separators differ from each other in the order only, so that comparing suffixes ends there
        apart[cut] = 1 + np.arange(len(cut))
        apart[-1] = 0
        order = suffix_order(apart)
        self.n, self.top = len(text), int(text.max())
        self.bwt = text[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, self.top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        # Every beginning of a stretch is sampled: a step back never crosses a separator, whose order is by place.
        marked = np.arange(len(text)) % sample == 0
        marked[cut + 1] = True
        self.sampled = np.where(marked[order], order, -1)

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (rows) at once: the rows of the suffix order that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            known = c <= self.top
            c = np.where(known, c, 0)
            low, high = self.before[c] + self.wavelet.rank(c, low), self.before[c] + self.wavelet.rank(c, high)
            high = np.where(known, high, low)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one is met."""
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = self.sampled[rows]
            hit = at >= 0
            found[open_[hit]] = at[hit] + steps
            open_, rows = open_[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return found
