"""Vectorised byte-level text helpers shared by the operators of this subpackage.

All helpers work on a *block*: the UTF-8 bytes of some rows laid end to end plus the row offsets. A block holds at most
``BLOCK_BYTES`` (or one row), which bounds the memory of every numpy temporary whatever the Arrow batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
SPACES = bytes([32, *range(9, 14)])

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
#: Everything in ASCII but letters and digits; bytes of other scripts count as letters.
IS_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 65536) if have is None else max(n, 2 * len(have))
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window_hash`` derives the hash of any byte range."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(len(data)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of the bytes start..end (arrays), with the length mixed in."""
    inverse = powers(len(prefix), _INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets) of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, rows: np.ndarray, lower: bool = True, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than ``breaks`` (ASCII white space), never across rows.

    Returns the words' hashes (of the bytes with A-Z lower-cased), starts, ends, and for each row the index of its first
    word (one entry more than rows).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(rows), dtype=np.int64)
    if lower:
        data = LOWER[data]
    solid = ~breaks[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = window_hash(rolling(data), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, rows)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``size``-word shingles in order, and each row's first index (one entry more than rows).

    A row of fewer words, but at least one, has its whole sequence as the only shingle; a row without words has none.
    """
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.zeros(len(first), dtype=np.int64)
    np.cumsum(made, out=offsets[1:])
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    if not len(out):
        return out, offsets
    whole = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for k in range(size):
        whole = whole * U64(_BASE) + hashes[k : k + len(whole)]
    at = np.repeat(first[:-1] - offsets[:-1], made) + np.arange(len(out))
    long_row = np.repeat(count >= size, made)
    out[long_row] = whole[at[long_row]]
    for row in np.flatnonzero((count > 0) & (count < size)):
        value = 0
        for h in hashes[first[row] : first[row + 1]].tolist():
            value = (value * _BASE + h) & 0xFFFFFFFFFFFFFFFF
        out[offsets[row]] = (value + int(count[row]) * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF
    return mix(out), offsets


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving what it has freed back to the machine at its end: Spark keeps Python workers for later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole
