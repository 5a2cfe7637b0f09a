"""Media columns: payload bytes kept losslessly in progressive JPEG, and RGB tensors decoded from it.

``store`` writes one payload byte per quantised DCT coefficient (the unit of the format; all quantisers are 1): the 64
coefficients of a block, blocks in MCU order, luma at twice the chroma resolution both ways. An AC coefficient carries the byte
as its sign (top bit) and a magnitude of 128 plus the low seven bits; a DC coefficient is the byte itself. The file is an
ordinary progressive one: spectral selection (DC, AC) and successive approximation (each coefficient's last bit in a
refinement scan). ``coefficients`` accumulates the scans of a progressive file into coefficient arrays, ``rgb`` dequantises,
inverse-transforms in numpy, upsamples chroma and converts to RGB.

Runs of equal-length symbols are decoded as arrays: a first AC scan whose table has a single symbol has a fixed stride, and in
a refinement an end-of-band run over coefficients that are all non-zero is plain bits. Everything else goes symbol by symbol.

Defined results: null or empty text is one unit of padding; equal texts give equal files; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
MCU_BLOCKS = 6
#: Blocks to a row of MCUs; with it a payload's height follows from its length.
ROW_MCUS = 32
# The zigzag order of the format, coefficient by row and column of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k = np.arange(8)
#: Orthonormal inverse DCT basis: samples = BASIS @ coefficients @ BASIS.T.
BASIS = (np.sqrt(np.where(_k == 0, 1, 2) / 8)[None, :] * np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16)).astype(np.float32)
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(text: bytes) -> bytes:
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, ident: int, symbols: dict[int, list[int]]) -> bytes:
    """A Huffman table: symbols by code length."""
    counts = bytes(len(symbols.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | ident]) + counts + bytes(s for n in range(1, 17) for s in symbols.get(n, [])))


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray | bytes) -> bytes:
    """A scan's header and its entropy-coded bits (padded with ones, 255 stuffed)."""
    if not isinstance(bits, bytes):
        bits = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    head = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


# Fixed tables: four-bit codes for the nine DC categories, one-bit codes for the only AC symbol of each scan kind.
DC_TABLE = {4: list(range(9))}
AC_FIRST = {1: [0x07]}
RUN_SYMBOLS = {4: [n << 4 for n in range(15)]}


TABLES = _table(0, 0, DC_TABLE) + _table(1, 0, AC_FIRST) + _table(1, 1, RUN_SYMBOLS)


def _bits_of(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bits of values laid end to end, most significant first."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(ends, widths) - np.arange(total) - 1
    return (np.repeat(values, widths) >> shift & 1).astype(np.uint8)


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload of a positive multiple of ``UNIT`` bytes."""
    raw = np.frombuffer(payload, np.uint8).astype(np.int32)
    blocks = len(raw) // 64
    mcus = -(-blocks // MCU_BLOCKS)
    across = min(mcus, ROW_MCUS)
    down = -(-mcus // across)
    full = np.zeros((across * down * MCU_BLOCKS, 64), np.int32)
    full[:blocks] = raw.reshape(-1, 64)
    spare = np.arange(len(full)) >= blocks
    coef = np.where(full & 128, -(128 | full & 127), 128 | full & 127)
    coef[spare] = 128
    coef[:, 0] = full[:, 0]
    parts = planes(coef, across, down)
    out = [b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # the number of blocks with payload goes into a comment: a file may end with spare blocks
    out.append(_segment(0xFE, struct.pack(">I", blocks)))
    out.append(TABLES)
    # DC, first scan: all but the last bit, as differences within each component in MCU order
    dc = coef[:, 0] >> 1
    kind = np.tile(np.array([0, 0, 0, 0, 1, 2]), across * down)
    diff = np.zeros(len(dc), np.int32)
    for c in range(3):
        diff[kind == c] = np.diff(dc[kind == c], prepend=0)
    size = np.searchsorted(1 << np.arange(8), np.abs(diff), side="right")
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _bits_of(size << size | extra, 4 + size)))
    for c, plane in enumerate(parts):
        ac = plane.reshape(-1, 64)[:, 1:]
        value = np.abs(ac) >> 1
        code = np.where(ac < 0, 127 - value, value).astype(np.uint8)  # a zero bit for the symbol, then seven bits
        out.append(_scan([(c + 1, 0)], 1, 63, 0, 1, code.tobytes()))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, (coef[:, 0] & 1).astype(np.uint8)))
    for c, plane in enumerate(parts):
        ac = (np.abs(plane.reshape(-1, 64)[:, 1:]) & 1).astype(np.uint8)
        bits, at = [], 0
        while at < len(ac):
            n = int(np.log2(min(len(ac) - at, 0x7FFF)))
            run = min(len(ac) - at, (1 << n + 1) - 1)
            bits += [_bits_of(np.array([n << n | run - (1 << n)]), np.array([4 + n])), ac[at : at + run].reshape(-1)]
            at += run
        out.append(_scan([(c + 1, 1)], 1, 63, 1, 0, np.concatenate(bits)))
    return b"".join(out) + b"\xff\xd9"


def planes(coef: np.ndarray, across: int, down: int) -> list[np.ndarray]:
    """Blocks in MCU order as (rows, columns, 64) of Y, Cb and Cr."""
    mcu = coef.reshape(down, across, MCU_BLOCKS, 64)
    luma = mcu[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down * 2, across * 2, 64)
    return [luma, mcu[:, :, 4], mcu[:, :, 5]]


@dataclass
class _Image:
    """What the headers and scans have given so far; coefficients are in zigzag order."""

    height: int = 0
    width: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    sampling: list[tuple[int, int, int, int]] = field(default_factory=list)
    coef: list[np.ndarray] = field(default_factory=list)
    tables: dict[tuple[int, int], dict] = field(default_factory=dict)


_numbers: dict[bytes, int] = {b"": 0}


class _Bits:
    """Reader over the bits of one scan."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.at = bits, 0
        self.text = bits.tobytes()

    def take(self, n: int) -> int:
        key = self.text[self.at : self.at + n]
        self.at += n
        value = _numbers.get(key)
        if value is None:  # numbers have up to 15 bits
            value = _numbers[key] = int(bytes(48 + b for b in key), 2)
        return value

    def symbol(self, table: dict) -> int:
        begin = self.at
        for n in table["lengths"]:
            found = table.get((n, self.take(n)))
            if found is not None:
                return found
            self.at = begin
        raise ValueError("no such code in the Huffman table")

    def extended(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1


@lru_cache(64)
def huffman_tables(body: bytes) -> dict[tuple[int, int], dict]:
    """(kind, identifier) -> {(length, code): symbol, "lengths": code lengths in use} of a table segment."""
    out = {}
    while body:
        counts, code, k, table = body[1:17], 0, 17, {}
        for n in range(16):
            for _ in range(counts[n]):
                table[n + 1, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        table["lengths"] = [n + 1 for n in range(16) if counts[n]]
        out[body[0] >> 4, body[0] & 15] = table
        body = body[k:]
    return out


def coefficients(media: bytes) -> _Image:
    """Coefficient arrays of a progressive JPEG (no restart intervals)."""
    image, at = _Image(), 2
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            image.tables |= huffman_tables(body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.sampling = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
            across = -(-image.width // (8 * max(h for _, h, _, _ in image.sampling)))
            down = -(-image.height // (8 * max(v for _, _, v, _ in image.sampling)))
            image.coef = [np.zeros((down * v, across * h, 64), np.int32) for _, h, v, _ in image.sampling]
        elif marker == 0xDA:
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            raw = media[at:end].replace(b"\xff\x00", b"\xff")
            _apply(image, body, _Bits(np.unpackbits(np.frombuffer(raw, np.uint8))))
            at = end
    return image


def _apply(image: _Image, head: bytes, bits: _Bits) -> None:
    """Accumulate one scan."""
    n = head[0]
    ids = [c for c, _, _, _ in image.sampling]
    parts = [(ids.index(head[1 + 2 * k]), head[2 + 2 * k]) for k in range(n)]
    first, last, step = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n]
    high, low = step >> 4, step & 15
    if first == 0:
        views = []  # block views of each component in scan order
        for c, t in parts:
            _, h, v, _ = image.sampling[c]
            own = image.coef[c]
            if n > 1:
                rows, columns = own.shape[0] // v, own.shape[1] // h
                index = np.arange(own.shape[0] * own.shape[1]).reshape(rows, v, columns, h).transpose(0, 2, 1, 3).reshape(rows * columns, v * h)
            else:
                index = np.arange(own.shape[0] * own.shape[1]).reshape(-1, 1)
            views.append((c, t, index))
        if high:  # one bit a block
            width = sum(index.shape[1] for _, _, index in views)
            plain = bits.bits[: width * len(views[0][2])].reshape(-1, width).astype(np.int32)
            begin = 0
            for c, _, index in views:
                image.coef[c].reshape(-1, 64)[index, 0] |= plain[:, begin : begin + index.shape[1]] << low
                begin += index.shape[1]
            return
        seen, values = [0] * len(views), [[] for _ in views]
        for _ in range(len(views[0][2])):
            for k, (_, t, index) in enumerate(views):
                table = image.tables[0, t >> 4]
                for _ in range(index.shape[1]):
                    seen[k] += bits.extended(bits.symbol(table))
                    values[k].append(seen[k])
        for (c, _, index), got in zip(views, values, strict=True):
            image.coef[c].reshape(-1, 64)[index.reshape(-1), 0] = np.array(got, np.int32) << low
        return
    c, t = parts[0]
    table = image.tables[1, t & 15]
    band = image.coef[c].reshape(-1, 64)[:, first : last + 1]
    if high:
        _refine(band, table, bits, 1 << low)
    elif len(table) == 2 and 0 < (only := next(iter(table.items())))[1] <= 8:
        length, size = only[0][0], only[1]
        stride = length + size
        cells = bits.bits[: band.size * stride].reshape(-1, stride)[:, length:]
        value = np.packbits(cells, axis=1)[:, 0].astype(np.int32) >> 8 - size
        band[:] = (np.where(cells[:, 0], value, value - (1 << size) + 1) << low).reshape(band.shape)
    else:
        _first(band, table, bits, low)


def _first(band: np.ndarray, table: dict, bits: _Bits, low: int) -> None:
    """First AC scan, symbol by symbol."""
    run = 0
    for block in band:
        if run:
            run -= 1
            continue
        k = 0
        while k < len(block):
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                block[k] = bits.extended(size) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _refine(band: np.ndarray, table: dict, bits: _Bits, one: int) -> None:
    """Refinement AC scan: a bit for every coefficient that is already non-zero, new ones by symbols."""

    def fix(block: np.ndarray, k: int) -> None:
        if bits.take(1):
            block[k] += one if block[k] > 0 else -one

    at, run = 0, 0
    while at < len(band):
        if run:
            own = band[at : at + run]
            if own.all():  # plain bits, taken together
                plain = bits.bits[bits.at : bits.at + own.size].reshape(own.shape).astype(np.int32)
                own += np.where(own > 0, plain, -plain) * one
                bits.at += own.size
            else:
                for block in own:
                    for k in np.flatnonzero(block):
                        fix(block, k)
            at, run = at + run, 0
            continue
        block, k = band[at], 0
        while k < len(block):
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            if not size and skip < 15:
                run = (1 << skip) + bits.take(skip)
                if not k:
                    break  # the run begins with this whole block
                for rest in range(k, len(block)):
                    if block[rest]:
                        fix(block, rest)
                run -= 1
                break
            new = (one if bits.take(1) else -one) if size else 0
            while k < len(block):
                if block[k]:
                    fix(block, k)
                elif skip:
                    skip -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        at += k > 0


def payload(image: _Image) -> bytes:
    """The payload that ``store`` has put into the coefficients."""
    luma, cb, cr = image.coef
    down, across = cb.shape[:2]
    mcu = np.empty((down, across, MCU_BLOCKS, 64), np.int32)
    mcu[:, :, :4] = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    mcu[:, :, 4], mcu[:, :, 5] = cb, cr
    blocks = mcu.reshape(-1, 64)[: struct.unpack(">I", image.comment)[0]]
    out = (np.abs(blocks) & 127 | np.where(blocks < 0, 128, 0)).astype(np.uint8)
    out[:, 0] = blocks[:, 0]
    return out.tobytes()


def rgb(image: _Image) -> np.ndarray:
    """Full-resolution (height, width, 3) uint8 tensor."""
    tall, wide = max(v for _, _, v, _ in image.sampling), max(h for _, h, _, _ in image.sampling)
    channels = []
    for (_, h, v, q), coef in zip(image.sampling, image.coef, strict=True):
        rows, columns = coef.shape[:2]
        natural = np.empty((rows * columns, 64), np.float32)
        natural[:, ZIGZAG] = (coef * image.quant[q]).reshape(-1, 64)
        half = natural.reshape(-1, 8) @ BASIS.T
        block = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS.T  # columns last: transposed samples
        plane = block.reshape(rows, columns, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, columns * 8) + np.float32(128)
        channels.append(plane.repeat(tall // v, axis=0).repeat(wide // h, axis=1) if (tall // v, wide // h) != (1, 1) else plane)
    if len(channels) == 1:
        channels *= 3
        out = np.stack(channels, axis=-1)
    else:
        y, cb, cr = channels[0], channels[1] - 128, channels[2] - 128
        out = np.empty((*y.shape, 3), np.float32)
        out[..., 0], out[..., 1], out[..., 2] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[: image.height, : image.width]


def feature(tensor: np.ndarray) -> str:
    """Shape and mean of each channel over a 2 x 2 grid, as fixed-point text."""
    h, w = tensor.shape[:2]
    sums = np.add.reduceat(np.add.reduceat(tensor.astype(np.int64), [0, h // 2], axis=0), [0, w // 2], axis=1)
    area = np.outer([h // 2, h - h // 2], [w // 2, w - w // 2])
    return f"{h}x{w}:" + ",".join(str(x) for x in (sums * 100 // area[:, :, None]).reshape(-1).tolist())


MEDIA_SCHEMA = "doc_id long, media binary, height int, width int, rgb binary"


def media_columns(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """Per document: its media file and, if asked for, the RGB tensor read back from it (row-major uint8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: tensors are twice the text
                media = store(pad((batch.column(1)[i].as_py() or "").encode()))
                tensor = rgb(coefficients(media)) if tensors else np.zeros((0, 0, 3), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([media], pa.binary()), pa.array([tensor.shape[0]], pa.int32()), pa.array([tensor.shape[1]], pa.int32()), pa.array([tensor.tobytes() if tensors else None], pa.binary())], names=["doc_id", "media", "height", "width", "rgb"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_SCHEMA)


def media_digest(docs: DataFrame) -> DataFrame:
    """Lengths and digests of each document's payload, media file and tensor; files and tensors stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (value.as_py() or "").encode()
                media = store(pad(text))
                image = coefficients(media)
                back = payload(image)
                rows.append((doc_id, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb(image))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
