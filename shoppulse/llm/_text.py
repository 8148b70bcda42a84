"""Numpy helpers on Arrow text columns: byte views, slices of bounded size, words and hashes.

Texts stay UTF-8 bytes.  A word is a maximal run of bytes other than space and
0x09-0x0D.  Hashes are 64-bit polynomial sums of per-byte random values, mixed
at the end; equal strings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0x9FB21C651E98DF25)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict = {}


def powers(n: int, base=BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept, and grown when longer texts come)."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_slices(batch, name: str = "text", limit: int = SLICE_BYTES):
    """(i, j, offsets, bytes) of row ranges of a record batch."""
    off, data = utf8(batch.column(name))
    for i, j in slices(off, limit):
        yield i, j, off[i:j + 1] - off[i], data[off[i]:off[j]]


def ints(column, null: int = 0) -> np.ndarray:
    """An int64 numpy view of an integer Arrow column."""
    if column.null_count:
        column = column.fill_null(null)
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(data[s:e]) = span(P, s, e)."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end)."""
    inv = powers(len(p), INVERSE)
    return mix64((p[end] - p[start]) * inv[start] + (end - start).astype(U64))


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of every word; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    bounds = offsets[:-1][np.diff(offsets) > 0]
    first[bounds] = word[bounds]
    last[bounds[1:] - 1] = word[bounds[1:] - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def words(data: np.ndarray, offsets: np.ndarray):
    """(hash, row) of every word in order."""
    start, end, row = word_bounds(data, offsets)
    return span(prefix(data), start, end), row


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Sorted distinct hashes of word n-grams per row: (hash, row), ordered by row.

    A row of fewer words than ``width`` has one shingle, all of its words; a row
    without words has none.
    """
    h, row = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    total = np.zeros(len(h), U64)
    step = powers(width + 1)
    for k in range(min(width, len(h))):
        total[:len(h) - k] += h[k:] * step[k]
    at = np.arange(len(h))
    ok = at + width <= (begin + count)[row]
    for r in np.flatnonzero((count > 0) & (count < width)):
        i, c = begin[r], count[r]
        total[i] = (h[i:i + c] * step[:c]).sum(dtype=U64) + U64(c)
        ok[i] = True
    grams, row = mix64(total[ok]), row[ok]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[keep], row[keep]
