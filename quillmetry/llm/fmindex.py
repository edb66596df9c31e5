"""A compressed FM-index in NumPy: suffix array, Burrows-Wheeler transform and a wavelet matrix with rank blocks.

Many patterns are searched at once: every step extends all live patterns by one character to the left.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int, keep: int = 0) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols (rounded up to a power of 2), by prefix doubling.

    With `keep`, a power of 2 up to depth, also the rank of each suffix by its first `keep` symbols alone.
    """
    n = len(text)
    symbols, rank = np.unique(text, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    bits = len(symbols).bit_length()  # as many symbols as 63 bits hold are one key, 0 stands behind the end
    while bits * 2 * k < 64 and k < depth and (not keep or 2 * k <= keep):
        rank = rank << bits * k
        rank[: n - k] |= rank[k:] >> bits * k
        k *= 2
    kept = order = None
    key = rank
    while order is None or k < depth:
        if order is not None:
            key = rank * (n + 1)
            key[: n - k] += rank[k:] + 1
            k *= 2
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.cumsum(np.r_[0, (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if k <= keep:
            kept = rank
        if new[-1] == n - 1:
            break
    return (order, kept) if keep else order


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence of small integers, one bit plane per level."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        cur = seq
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level) & 1
            words = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view(np.uint64)
            sums = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.ones.append((words, sums))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        every = np.arange(1 << bits)
        self.begin = self._down(every, np.zeros_like(every))

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        words, sums = self.ones[level]
        w, r = at >> 6, (at & 63).astype(np.uint64)
        return sums[w] + np.bitwise_count(words[w] & ((np.uint64(1) << r) - np.uint64(1))).astype(np.int64)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place at of the sequence comes to stand on the last level if it goes the way of symbol."""
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self._rank1(i, at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place at, for arrays of both."""
        return self._down(symbol, at) - self.begin[symbol]


class FmIndex:
    """text: symbols 1.. ; 0 parts the pieces and is never part of a pattern. Patterns have `width` + 1 symbols at most."""

    def __init__(self, text: np.ndarray, width: int):
        self.alphabet, coded = np.unique(text, return_inverse=True)
        self.text, self.width = coded.astype(np.int64), width
        keep = 1 << (width.bit_length() - 1)
        self.sa, self._kept = suffix_array(self.text, width + 2, keep)
        self._rest = width - keep
        bwt = self.text[self.sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(self.alphabet)))])
        self.wavelet = WaveletMatrix(bwt, max(1, int(len(self.alphabet) - 1).bit_length()))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with the symbols c before them."""
        both = np.concatenate([c, c])
        got = self.first[both] + self.wavelet.rank(both, np.concatenate([lo, hi]))
        return got[: len(c)], got[len(c) :]

    def search(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffix array for each pattern text[start:end]; the patterns are pieces of the text itself."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.text), np.int64)
        live, at = np.arange(len(start)), end.copy()
        while len(live):
            live = live[(at[live] > start[live]) & (hi[live] > lo[live])]
            if not len(live):
                break
            at[live] -= 1
            lo[live], hi[live] = self.extend(self.text[at[live]], lo[live], hi[live])
        return lo, hi

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of the suffix array, begin and end of the interval of suffixes with the same first `width` symbols."""
        n = len(self.sa)
        after = np.full(n, -1, np.int64)
        after[: n - self._rest] = self._kept[self._rest :] if self._rest else self._kept
        a, b = self.sa[:-1], self.sa[1:]
        begins = np.flatnonzero(np.r_[True, (self._kept[a] != self._kept[b]) | (after[a] != after[b])])
        size = np.diff(np.r_[begins, n])
        return np.repeat(begins, size), np.repeat(begins + size, size)
