"""Words and hashes of Arrow text columns, vectorised over UTF-8 bytes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; these are all
ASCII, so byte runs and code point runs agree. Null texts count as empty.
Rows are processed in chunks of about ``CHUNK`` bytes, so a task's memory is
bounded by the chunk or by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
KEPT = CHUNK + 1  # powers of a base that are kept
U = np.uint64

_BASE = 0x9E3779B97F4A7C13  # odd and 3 modulo 8, so powers differ in their low bits
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(salt * 1000003)) * U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    return _kept_powers(base)[:n] if n <= KEPT else _new_powers(base, n)


@cache
def _kept_powers(base: int) -> np.ndarray:
    out = _new_powers(base, KEPT)
    out.flags.writeable = False
    return out


def _new_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets (one more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of consecutive rows: byte ranges, row numbers and hashes."""

    data: np.ndarray    # bytes of the rows
    offsets: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray   # byte range of each word
    end: np.ndarray
    row: np.ndarray     # row of each word
    first: np.ndarray   # first word of each row, and the end
    hash: np.ndarray    # 64-bit hash of each word

    def __len__(self) -> int:
        return len(self.start)


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """``fold``: a byte translation table used for hashing only."""
    n = len(data)
    base = offsets[0] if len(offsets) else 0
    offsets = offsets - base
    word = ~separators()[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    folded = data if fold is None else fold[data]
    return Words(data, offsets, start, end, row, first, range_hashes(folded, start, end))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes have equal hashes."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(seeds(256, 7)[data] * _powers(_BASE, n), dtype=U, out=total[1:])
    value = (total[end] - total[start]) * _powers(_INVERSE, n + 1)[start]
    return mix(value + (end - start).astype(U))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_BASE) + hashes[j:j + n]
    return mix(out)


def within(w: Words, k: int) -> np.ndarray:
    """Whether the run of ``k`` words from each word stays in its row."""
    n = len(w) - k + 1
    return w.row[:n] == w.row[k - 1:k - 1 + n] if n > 0 else np.zeros(0, bool)


def each_chunk(batch: pa.RecordBatch, column: str = "text", fold: np.ndarray | None = None,
               limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for chunks of a batch's text column."""
    data, offsets = utf8(batch.column(column))
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1], fold)


def spans(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each run of words ``a`` to ``b``; equal runs have equal hashes."""
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=U, out=total[1:])
    return mix((total[b] - total[a]) * _powers(_INVERSE, len(hashes) + 1)[a] + (b - a).astype(U))


def without_each(hashes: np.ndarray) -> np.ndarray:
    """For each word of one run, the spans() hash of the run without it."""
    n = len(hashes)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * _powers(_BASE, n), dtype=U, out=total[1:])
    return mix(total[:n] + (total[n] - total[1:]) * U(_INVERSE) + U(n - 1))
