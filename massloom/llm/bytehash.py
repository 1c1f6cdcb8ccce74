"""Vectorised hashing over the UTF-8 bytes of a batch of texts.

A batch of texts is one byte buffer with offsets, as Arrow stores it. Sums of
``T[byte] * B**position`` (mod 2**64) make the hash of every substring two look-ups and
a product, so words, shingles and rolling windows are hashed without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` mod 2**64, kept for the next batch up to 1M entries."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, 1 << 20)
        found = np.ones(size, dtype=U)
        done = 1
        while done < size:
            step = min(done, size - done)
            found[done : done + step] = found[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size <= 1 << 20:
            _powers[base] = found
    return found[:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero; see ``span_hash``."""
    out = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(_TABLE[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``buf[start:end]``, equal for equal bytes wherever they stand."""
    inv = powers(_INV, len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U))


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes."""
    n = len(sums) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    return mix((sums[width:] - sums[:-width]) * powers(_INV, len(sums))[:n])


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, rows, bytes, offsets) of runs of rows of about ``limit`` bytes.

    A null counts as an empty text; a longer text makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield first, last - first, data[lo:hi], offsets[first : last + 1] - lo
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes for which ``is_word`` holds within a row."""
    inside = is_word[buf]
    if not len(buf):
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, zero
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(buf))]
    starts[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def space_table() -> np.ndarray:
    """True for bytes that are not ASCII white space."""
    out = np.ones(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = False
    return out
