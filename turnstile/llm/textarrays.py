"""Whole-batch text arithmetic on Arrow buffers.

An Arrow string column is one byte buffer plus offsets.  These helpers find
words, hash them and build shingles for all documents of a batch with a few
numpy passes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system; a Python worker outlives its tasks and serves other stages."""
    if _POWERS and len(_POWERS[0]) > CHUNK_BYTES + 1:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run):
    """A task function over batches that releases its memory at its end."""
    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def tidy_group(run):
    """A function of one group that releases its memory at its end."""
    if run.__code__.co_argcount == 1:
        def tidied(group):
            try:
                return run(group)
            finally:
                release()
    else:
        def tidied(left, right):
            try:
                return run(left, right)
            finally:
                release()
    return tidied


def struct_field(rows: pa.StructArray, name: str) -> pa.Array:
    """One column of rows carried as structs, found as Spark finds it: by its name in any case."""
    names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
    at = names.index(name) if name in names else [n.lower() for n in names].index(name.lower())
    return rows.field(at)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing; equal inputs and only these give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each word's row."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= ink[edge]
    last[edge - 1] |= ink[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (equal bytes give equal hashes)."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    terms = _BYTE[data]
    terms *= up[:len(data)]
    np.cumsum(terms, out=total[1:])
    del terms                                               # 8 bytes for each of the text
    out = total[ends]
    out -= total[starts]
    del total
    out *= down[starts]
    out += (ends - starts).astype(np.uint64)
    return mix64(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of a row, and their rows.

    A row with fewer words has its whole sequence as one shingle; a row
    without words has none.  Order within a row is kept, repeats stay.
    """
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = len(hashes)
    left = counts[rows] - (np.arange(n) - begin[rows])      # words from here to the row's end
    whole = (counts[rows] < width) & (np.arange(n) == begin[rows])
    at = np.flatnonzero((left >= width) | whole)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = left[at] > k
        word = hashes[np.minimum(at + k, max(n - 1, 0))]
        out = np.where(there, mix64(out * np.uint64(3) + word + np.uint64(k + 1)), out)
    return out, rows[at]


def distinct_sorted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within the row (rows ascending)."""
    if len(values) == 0:
        return values, rows
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], r[keep]
