"""Bitmaps of hashes: a filter of bounded size that stops rows before they move (what it lets pass in error, joins drop later), and parities of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.text import U64, mix, tidy

#: Bits for each entry, and the largest bitmap's bits (32 MB) in powers of two. Beyond some 10^8 entries it passes nearly all.
PER_ENTRY, MOST = 16, 28
#: Bits of a page in powers of two (8 KB), and places of bits that a task gathers before it deals them to pages.
PAGE, HELD = 16, 1 << 20
#: Bytes of parities that are compared at a time.
CHUNK_BYTES = 1 << 23


def _at(values: np.ndarray, size: int) -> np.ndarray:
    return mix(values.view(np.uint64)) & U64(size - 1)


def bitmap(rows: DataFrame) -> np.ndarray:
    """Bits of all values of the one long column of ``rows``; only pages of bits reach the driver, which sets no bit and makes no object a word."""
    size = 1 << min(MOST, max(20, (PER_ENTRY * rows.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_at(batch.column(0).to_numpy(), size).astype(np.uint32))
            n += len(batch)
            if n >= HELD:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort(np.concatenate(held))
        pages, first = np.unique(at >> np.uint32(PAGE), return_index=True)
        offsets = (at & np.uint32((1 << PAGE) - 1)).astype(np.uint16).tobytes()
        bounds = (2 * np.append(first, len(at))).tolist()
        return pa.RecordBatch.from_arrays([pa.array(pages.astype(np.int32)), pa.array([offsets[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["page", "bits"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.zeros(1 << PAGE, dtype=bool)
                one[np.frombuffer(offsets, dtype=np.uint16)] = True
                bits = np.packbits(one, bitorder="little")
                own[page] = own[page] | bits if page in own else bits
        for page, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["page", "bits"])

    schema = "page int, bits binary"
    whole = rows.mapInArrow(tidy(places), schema).repartition("page").mapInArrow(tidy(filled), schema).collect()  # at most 4,096 pages of 8 KB
    out = np.zeros(size >> 3, dtype=np.uint8)
    for page, bits in whole:
        out[page << (PAGE - 3) : (page + 1) << (PAGE - 3)] = np.frombuffer(bits, dtype=np.uint8)
    return out.view("<u8")


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of 64-bit ``values`` are in the bitmap, or seem to be."""
    at = _at(values, len(bits) << 6)
    return bits[at >> U64(6)] >> (at & U64(63)) & U64(1) == 1


class Parities:
    """Parities of different lengths, compared by rows; the longer one of two is folded."""

    def __init__(self, raw: np.ndarray) -> None:
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.row = np.zeros(len(raw), dtype=np.int64)
        self.own: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            some = np.flatnonzero(self.size == size)
            self.row[some] = np.arange(len(some))
            self.own[size] = np.frombuffer(b"".join(raw[some].tolist()), np.uint64).reshape(len(some), size // 8)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the parities of rows ``x`` and ``y`` differ: a lower bound of the sets' difference."""
        out = np.zeros(len(x), dtype=np.int64)
        kinds = self.size[x] << 32 | self.size[y]
        for kind in np.unique(kinds).tolist():
            some, sides = np.flatnonzero(kinds == kind), (kind >> 32, kind & 0xFFFFFFFF)
            step = max(1, CHUNK_BYTES // max(sides))
            for part in (some[i : i + step] for i in range(0, len(some), step)):
                bits = [self.own[size][self.row[at[part]]] for size, at in zip(sides, (x, y), strict=True)]
                least = min(sides) // 8
                u, w = (b.reshape(len(part), -1, least) for b in bits)
                out[part] = np.bitwise_count(np.bitwise_xor.reduce(u, axis=1) ^ np.bitwise_xor.reduce(w, axis=1)).sum(axis=1, dtype=np.int64)
        return out
