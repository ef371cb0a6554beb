"""Vectorised text helpers that run inside Arrow tasks.

Words are runs of bytes other than space and TAB..CR; A-Z is lower-cased
byte by byte, which on UTF-8 touches ASCII letters only.  All hashes are
64-bit and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: ASCII bytes other than letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes worked on at once; temporaries take about 60 times as much, and a worker keeps much of that between its tasks.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def least_hashed(buckets: np.ndarray, most: int) -> np.ndarray:
    """Places, in order, of the ``most`` of some different buckets whose hashes are least; of all, if they aren't more."""
    if len(buckets) <= most:
        return np.arange(len(buckets))
    return np.sort(np.argsort(mix(buckets.astype(np.uint64) + U(1)), kind="stable")[:most])


_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _pow
    if len(_pow) < n:
        p = np.full(max(n, 1024), U(_BASE))
        p[0] = 1
        _pow = np.cumprod(p, dtype=np.uint64)
    return _pow[:n]


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # no chunk at all
        col = pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    if col.null_count and np.diff(offsets)[np.asarray(col.is_null())].any():  # else nulls hold no bytes, and nothing is copied
        col = col.fill_null("")
        offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(buf: np.ndarray, offsets: np.ndarray, limit: int = 0):
    """(first row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    limit, i, n = limit or PIECE, 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def breaks(b: np.ndarray, limit: int = 0, gaps: np.ndarray = SPACE) -> list[int]:
    """0, places of white space (or other ``gaps``) about ``limit`` bytes apart (more where a word is longer), and len(b)."""
    limit = limit or PIECE
    cuts, at, step = [0], limit, 1 << 12
    while at < len(b):
        hit = np.flatnonzero(gaps[b[at:at + step]])
        if len(hit):
            cuts.append(at + int(hit[0]))
            at = cuts[-1] + limit
        else:
            at += step
    return [*cuts, len(b)]


def words_ahead(b: np.ndarray, at: int, n: int) -> int:
    """Where the n-th word after the white space at ``at`` ends."""
    step = 1 << 10
    while at + step < len(b):
        solid = ~SPACE[b[at:at + step]]
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        if len(ends) >= n:
            return at + int(ends[n - 1])
        step *= 4
    return len(b)


def word_before(b: np.ndarray, at: int) -> int:
    """Where the last word before ``at`` starts; 0 if there is none."""
    step = 1 << 10
    while step < at:
        solid = ~SPACE[b[at - step:at]]
        starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        if len(starts):
            return at - step + int(starts[-1])
        step *= 4
    return 0


def is_long(offsets: np.ndarray) -> bool:
    """Whether these rows are one row that is worked on in stretches, so that temporaries don't grow with its length."""
    return len(offsets) == 2 and offsets[1] - offsets[0] > 2 * PIECE


class Words:
    """The words of some rows: 64-bit hash, row, start and end byte of each, in order.  ``gaps``: the bytes between words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        low = LOWER[buf]
        n = len(low)
        solid = ~gaps[low]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.low, self.solid, self.rows = low, solid, len(offsets) - 1
        self.per_row = np.bincount(self.row, minlength=self.rows)
        if len(self.start):
            at = np.flatnonzero(solid)
            lens = self.end - self.start
            heads = np.cumsum(lens) - lens
            rel = np.arange(len(at)) - np.repeat(heads, lens)
            v = (low[at].astype(np.uint64) + U(1)) * powers(int(lens.max()))[rel]
            self.hash = mix(np.add.reduceat(v, heads) + lens.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def shingles(self, k: int = 5, short_rows: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, index of the first word) of each run of k words; a row of 1..k-1 words has its whole sequence as one, if asked."""
        m = len(self.hash)
        weight = [U((int(_BASE) * (2 * j + 3) ** 5 | 1) & (2**64 - 1)) for j in range(k)]
        at = np.flatnonzero(self.row[:m - k + 1] == self.row[k - 1:]) if m >= k else np.zeros(0, np.int64)
        s = np.zeros(len(at), np.uint64)
        for j in range(k):
            s += self.hash[at + j] * weight[j]
        short = np.flatnonzero((self.per_row > 0) & (self.per_row < k) & short_rows)
        if len(short):
            heads = np.cumsum(self.per_row) - self.per_row
            h0 = heads[short]
            t = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = self.per_row[short] > j
                t[has] += self.hash[h0[has] + j] * weight[j]
            t += self.per_row[short].astype(np.uint64)
            at, s = np.concatenate([at, h0]), np.concatenate([s, t])
        return self.row[at], mix(s), at


def per_row_distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, ordered by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
