"""An FM-index over a sequence of small integers: suffix array, wavelet matrix of its BWT, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the suffixes of seq in their order; symbols take `bits` bits. Ends before a longer equal one.

    The first sort takes as many symbols as fit 62 bits; after that prefixes double, and only runs that
    are still tied are sorted again.
    """
    n, per = len(seq), max(1, 62 // (bits + 1))
    key = np.zeros(n, np.uint64)
    for j in range(per):
        key <<= np.uint64(bits + 1)
        key[: max(0, n - j)] |= seq[j:].astype(np.uint64) + np.uint64(1)
    sa = np.argsort(key)
    key = key[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(slots):
        at = sa[slots]
        later = at + per
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = (rank[at] << 31) | second
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        per *= 2
    return sa


class FMIndex:
    """Counts and locates phrases in a sequence of symbols from 1 to `top`; 0 is kept for its end."""

    SAMPLE = 16

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.append(seq, 0).astype(np.int32)
        self.n, self.levels = len(seq), max(1, int(top).bit_length())
        sa = suffix_array(seq, self.levels)
        self.marked = sa % self.SAMPLE == 0
        self.samples = sa[self.marked]
        self.marks = np.concatenate([[0], np.cumsum(self.marked, dtype=np.int32)])
        left = seq[sa - 1]  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            left = np.concatenate([left[~bit], left[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` symbols of the BWT."""
        start = np.zeros_like(at)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The BWT's symbol at each row."""
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[row + 1] > ones[row]
            out = out << 1 | one
            row = np.where(one, zeros + ones[row], row - ones[row])
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase (a row's first `length` symbols) the range of suffixes that begin with it."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - step]
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each suffix: steps back through the text until a sampled one."""
        out, steps, todo, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(todo):
            known = self.marked[row]
            out[todo[known]] = self.samples[self.marks[row[known]]] + steps
            todo, row = todo[~known], row[~known]
            symbol = self.symbol(row)
            row = self.before[symbol] + self.rank(symbol, row)
            steps += 1
        return out
