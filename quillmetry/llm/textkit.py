"""Vectorised text helpers for Arrow batches: words, lines and hashes of word runs, with no Python loop per word.

A chunk of texts becomes one array of code points. Tables of letters, digits and lower case give the words, prefix sums
of a polynomial their hashes. Chunks hold about MAX_CHARS characters (or one longer text), so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CHARS = 1_000_000
_TABLE = 0x20000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def chunks(batch: pa.RecordBatch, text: str, most: int = MAX_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about `most` bytes of text each, at least one row."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = n[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(n, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter-or-digit of the code points under 0x20000; letters beyond have no case."""
    lower = np.arange(_TABLE, dtype=np.uint32)
    alnum = np.zeros(_TABLE, bool)
    for i in range(_TABLE):
        c = chr(i)
        alnum[i] = c.isalnum()
        low = c.lower()
        if low != c and len(low) == 1:
            lower[i] = ord(low)
    return lower, alnum


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts one after another, and where each text begins (with the end as last entry)."""
    values = pc.fill_null(texts, "").to_pylist()
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    return np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(sizes)]


def prefix_hashes(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial; span_hashes takes spans from them."""
    p, _ = powers(len(cp) + 1)
    s = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    return s


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the characters start..end: equal spans, equal hashes, anywhere and in every batch."""
    _, inverse = powers(len(s))
    return mix((s[end] - s[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    cp: np.ndarray  # code points
    at: np.ndarray  # start of each text, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    row: np.ndarray  # text of each word
    hash: np.ndarray  # of the word in lower case

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text of each line (line feeds part lines, empty ones count) and line of each word."""
        breaks = np.flatnonzero(self.cp == 10)
        per_text = np.diff(np.searchsorted(breaks, self.at)) + 1
        return np.repeat(np.arange(len(per_text)), per_text), np.searchsorted(breaks, self.start) + self.row


def words_of(texts: pa.Array) -> Words:
    """The runs of letters and digits of each text. Null is read as the empty text."""
    cp, at = code_points(texts)
    lower, alnum = _tables()
    if len(cp) and cp.max() >= _TABLE:
        small = np.minimum(cp, _TABLE - 1)
        is_word = np.where(cp < _TABLE, alnum[small], cp < 0x40000)
        low = np.where(cp < _TABLE, lower[small], cp)
    else:
        is_word, low = alnum[cp], lower[cp]
    before = np.zeros(len(cp), bool)
    before[1:] = is_word[:-1]
    inner = at[1:-1]
    before[inner[inner < len(cp)]] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(cp), bool)
    after[:-1] = is_word[1:] & before[1:]
    end = np.flatnonzero(is_word & ~after) + 1
    row = np.searchsorted(at, start, side="right") - 1
    return Words(cp, at, start, end, row, span_hashes(prefix_hashes(low), start, end))


def run_hashes(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within one row, and the place of its first word."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(codes) - n + 1
    h = codes[:last].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += codes[k : k + last]
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    return mix(h[at]), at


def repeated_words(codes: np.ndarray, row: np.ndarray, n: int = 4) -> np.ndarray:
    """Of each word, whether it lies in a run of n words that began earlier in the same row too."""
    h, at = run_hashes(codes, row, n)
    flags = np.zeros(len(codes) + 1, np.int32)
    if len(h):
        key = h + row[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        start = at[again]
        flags[:-1] += np.bincount(start, minlength=len(codes)).astype(np.int32)
        flags -= np.bincount(np.minimum(start + n, len(codes)), minlength=len(codes) + 1).astype(np.int32)
    return np.cumsum(flags[:-1]) > 0
