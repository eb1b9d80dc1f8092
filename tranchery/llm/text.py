"""Whole-batch text primitives: words, word hashes and n-gram hashes of Arrow string columns, by numpy.

Hashes are 64-bit polynomial sums over bytes (randomised byte table, odd base, modulo 2**64) with a finishing mix.
Two different texts agree with a chance of about 2**-64; where a wrong match would matter, callers verify the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words made of ASCII digits, ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finishing permutation (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept for the process, up to 2**22 entries."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 21)
        row = np.full(size, base, np.uint64)
        row[0] = 1
        have = np.cumprod(row, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (a longer single row is a slice of its own)."""
    _, at = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


class Words:
    """The words of a string column: bounds (bytes), row numbers and hashes of each.  Bytes are ASCII-lower-cased."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray | None = None):
        data, self.offsets = utf8(column)
        self.data = LOWER[data]
        inside = ~ASCII_SPACE[data] if word_bytes is None else word_bytes[data]
        first = np.zeros(len(data) + 1, bool)
        first[self.offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(self.offsets) - 1)
        self.rows = len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * _power(_BASE, n)[:n], out=total[1:])
        out = (total[self.end] - total[self.start]) * _power(_INVERSE, n)[self.start]
        return mix(out + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def phrase(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 joined by one space."""
        return b" ".join(self.word(k) for k in range(i, i + n))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours (ignores row bounds)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += hashes[k : k + count]
        out = mix(out)
    return out


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles as (row, hash), sorted by row and hash; a row with fewer words gives its whole sequence."""
    h = words.hashes()
    long_rows = words.counts >= n
    grams = chain(h, n)
    start = words.row[: len(grams)]
    ok = start == words.row[n - 1 :] if len(grams) else np.zeros(0, bool)
    rows, vals = [start[ok]], [grams[ok]]
    first = np.concatenate([[0], np.cumsum(words.counts)[:-1]])
    for size in range(1, n):
        short = np.flatnonzero((words.counts == size) & ~long_rows)
        if len(short):
            at = first[short]
            v = h[at].copy()
            for k in range(1, size):
                v = mix(v * np.uint64(_BASE) + h[at + k])
            rows.append(short)
            vals.append(v + np.uint64(size))
    row, val = np.concatenate(rows), np.concatenate(vals)
    order = np.lexsort((val, row))
    row, val = row[order], val[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (val[1:] != val[:-1])
    return row[keep], val[keep]
