import hashlib
import zlib

import numpy as np
import pytest

from lectern.llm import media


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media.ZIGZAG[-3:].tolist() == [55, 62, 63]


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 64 * 6 * 32 * 3, 130_001])
def test_round_trip(n):
    data = media.pad(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    assert len(data) % 576 == 0 and len(data)
    stored = media.store(data)
    assert media.payload(media.coefficients(stored)) == data


@pytest.mark.parametrize("fill", [0, 127, 128, 255])
def test_constant_payloads(fill):
    data = bytes([fill]) * 1152
    assert media.payload(media.coefficients(media.store(data))) == data


def test_idct_against_the_definition():
    image = media.coefficients(media.store(media.pad(b"abc" * 400)))
    coef = image.coef[0][0, 0]
    block = np.zeros((8, 8))
    for k in range(64):
        v, u = divmod(int(media.ZIGZAG[k]), 8)
        cu, cv = (np.sqrt(0.5) if u == 0 else 1), (np.sqrt(0.5) if v == 0 else 1)
        for y in range(8):
            for x in range(8):
                block[y, x] += cu * cv / 4 * coef[k] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    gray = media._Image(8, 8, b"", image.quant, [(1, 1, 1, 0)], [image.coef[0][:1, :1]])
    assert np.abs(media.rgb(gray)[..., 0].astype(int) - np.clip(np.rint(block + 128), 0, 255)).max() <= 1


def code_bits(tables, symbol):
    return next([code >> n - 1 - i & 1 for i in range(n)] for (n, code), s in [x for x in tables.items() if x[0] != "lengths"] if s == symbol)


def test_symbol_by_symbol_scans():
    """Sparse coefficients through first and refinement scans that an independent encoder writes."""
    rng = np.random.default_rng(3)
    want = np.where(rng.random((40, 63)) < 0.15, rng.integers(-30, 31, (40, 63)), 0)
    want[5:9] = 0
    symbols = sorted({r << 4 | s for r in range(16) for s in range(6)} | {0xF0})
    table, code = {}, 0
    for s in symbols:
        table[7, code] = s
        code += 1
    table["lengths"] = [7]
    bits = []
    high = np.sign(want) * (np.abs(want) >> 1)
    for block in high:  # first scan, Al = 1
        at, hits = 0, np.flatnonzero(block)
        for k in hits:
            gap = k - at
            while gap > 15:
                bits += code_bits(table, 0xF0)
                gap -= 16
            v = int(block[k])
            size = abs(v).bit_length()
            bits += code_bits(table, gap << 4 | size) + [(v if v > 0 else v + (1 << size) - 1) >> size - 1 - i & 1 for i in range(size)]
            at = k + 1
        if at < 63:
            bits += code_bits(table, 0)
    band = np.zeros((40, 63), np.int32)
    media._first(band, table, media._Bits(np.array(bits, np.uint8)), 1)
    assert (band == high * 2).all()
    bits = []
    for block, known in zip(want, high, strict=True):  # refinement, Al = 0
        fresh = [k for k in range(63) if known[k] == 0 and abs(block[k]) == 1]
        at = 0
        for k in fresh:
            while True:
                zeros = [i for i in range(at, k) if known[i] == 0]
                if len(zeros) <= 15:
                    break
                stop = zeros[15]
                bits += code_bits(table, 0xF0) + [abs(int(block[i])) & 1 for i in range(at, stop + 1) if known[i]]
                at = stop + 1
            bits += code_bits(table, len(zeros) << 4 | 1) + [int(block[k] > 0)] + [abs(int(block[i])) & 1 for i in range(at, k) if known[i]]
            at = k + 1
        if at < 63:
            bits += code_bits(table, 0) + [abs(int(block[i])) & 1 for i in range(at, 63) if known[i]]
    media._refine(band, table, media._Bits(np.array(bits, np.uint8)), 1)
    assert (band == want).all()


def test_query(spark, tmp_path):
    texts = [None, "", "é🙂" * 500, "x" * 576, "x" * 576, "long " * 30_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id as media").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in media.op7_media_columns(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = media.pad(raw)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert rows[3]["media_sha256"] == rows[4]["media_sha256"] and rows[3]["feature"] == rows[4]["feature"]
    first = media.media_columns(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("doc_id = 2").first()
    assert len(first["rgb"]) == first["height"] * first["width"] * 3
