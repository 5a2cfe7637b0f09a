"""Language identification by error-correcting output codes.

Every language has a codeword; one linear classifier over hashed character n-grams predicts each bit. Decoding weighs each
bit's logistic loss by the bit's accuracy on the training rows and takes the codeword of least loss; a small lead over the
runner-up flags the document as ambiguous.

Defined results: null text, or text without a letter, is ``und`` with score 0; rows whose language is null don't train; ties
go to the language that sorts first; with no training rows every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.text import LOWER, blocks

#: Hash buckets of n-grams; the model is BUCKETS x bits float32, whatever the corpus holds.
BUCKETS = 1 << 15
BITS = 15
SIZES = (1, 2, 3, 4)
#: Codeword losses closer than this share of the mean flag a document as ambiguous.
AMBIGUOUS = 0.1
HAS_LETTER = regex.compile(r"\p{L}").search


def codewords(n: int) -> np.ndarray:
    """Distinct codewords of -1 and 1 for n languages, far from each other: every split for up to 4, else random ones."""
    if n < 2:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 4:
        split = np.arange(1, 1 << (n - 1))
        return np.array([[-1.0 if row and s >> (row - 1) & 1 else 1.0 for s in split] for row in range(n)], dtype=np.float32)
    bits = max(BITS, 4 * int(np.ceil(np.log2(n))))
    best, best_gap = None, -1
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        apart = (bits - code @ code.T) / 2
        gap = apart[~np.eye(n, dtype=bool)].min()
        if gap > best_gap and (np.abs(code.sum(axis=0)) < n).all():
            best, best_gap = code, gap
    return best.astype(np.float32)


def ngram_buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, bucket of the n-gram that begins at each byte) over lower-cased bytes."""
    raw = LOWER[data].astype(np.uint32)
    code = np.zeros(len(raw), dtype=np.uint32)
    for size in range(1, max(SIZES) + 1):
        if len(raw) < size:
            return
        code = code[: len(raw) - size + 1] * np.uint32(0x01000193) + raw[size - 1 :] + np.uint32(1)
        if size in SIZES:
            yield size, ((code * np.uint32(0x9E3779B1) + np.uint32(size)) >> np.uint32(17)).astype(np.int32)


@dataclass
class Model:
    """Codewords, per-bit n-gram weights, per-bit offsets and reliabilities."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Mean evidence for each bit of each row (rows x bits)."""
        n = len(rows) - 1
        total = np.zeros((n, self.code.shape[1]), dtype=np.float64)
        for size, bucket in ngram_buckets(data):
            begin, end = rows[:-1], np.maximum(rows[:-1], rows[1:] - size + 1)
            for bit in range(total.shape[1]):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.weights[:, bit][bucket], out=sums[1:])
                at = np.minimum(end, len(bucket))
                total[:, bit] += sums[at] - sums[np.minimum(begin, len(bucket))]
        return total / np.maximum(1, np.diff(rows))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row."""
        z = np.clip(margins * self.scale, -30, 30)
        loss = np.stack([(np.logaddexp(0, -z * word) * self.trust).sum(axis=1) for word in self.code], axis=1) / self.trust.sum()
        best = loss.argmin(axis=1)
        weight = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        order = np.sort(loss, axis=1)
        close = order[:, 1] - order[:, 0] < AMBIGUOUS * order.mean(axis=1) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, weight.max(axis=1) / weight.sum(axis=1), close


def train(rows: DataFrame) -> Model | None:
    """A model from all rows of ``text`` and ``lang`` (nulls excluded). Only bucket sums reach the driver."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    names = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), len(SIZES), BUCKETS), dtype=np.int64)
        for batch in batches:
            own = np.array([names[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for first, end, data, offsets in blocks(batch.column(1)):
                for k, (size, bucket) in enumerate(ngram_buckets(data)):
                    row = np.repeat(own[first:end], np.diff(offsets))[: len(bucket)]
                    held[:, k] += np.bincount(row * BUCKETS + bucket, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS)
        for i in range(len(languages)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([held[i].astype(np.int64).tobytes()], pa.binary())], names=["lang", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SIZES) * BUCKETS, dtype=np.int64)
        for part in parts:
            for x in part.column("counts"):
                total += np.frombuffer(x.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    parts = rows.mapInArrow(count, "lang long, counts binary").withColumn("part", F.spark_partition_id() % 16)
    some = parts.groupBy("lang", "part").applyInArrow(add, "lang long, counts binary")
    sums = np.zeros((len(languages), len(SIZES), BUCKETS))
    for r in some.groupBy("lang").applyInArrow(add, "lang long, counts binary").collect():
        sums[r["lang"]] = np.frombuffer(r["counts"], dtype=np.int64).reshape(len(SIZES), BUCKETS)
    return fit(languages, sums)


def fit(languages: list[str], sums: np.ndarray) -> Model:
    """Smoothed log-odds of each bucket for each bit, from counts by language, n-gram size and bucket."""
    code = codewords(len(languages))
    share = (sums + 0.5) / (sums + 0.5).sum(axis=2, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    trust = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        up, down = code[:, bit] > 0, code[:, bit] < 0
        if up.any() and down.any():
            odds = np.log(share[up].mean(axis=0)) - np.log(share[down].mean(axis=0))
            # all sizes share the buckets: weigh by how often each size falls into a bucket
            use = sums.sum(axis=0) + 1e-9
            weights[:, bit] = ((odds * use).sum(axis=0) / use.sum(axis=0)).astype(np.float32)
            drift = (share * weights[:, bit]).sum(axis=(1, 2)) / len(SIZES)
            trust[bit] = max(1e-3, float((drift * code[:, bit]).min()))
    use = sums.sum(axis=(0, 1))
    spread = np.sqrt((weights**2 * (use / max(1.0, use.sum()))[:, None]).sum(axis=0)) + 1e-6
    return Model(languages, code, weights, 4.0 / spread, trust / trust.max())


PREDICTION = "lang_pred string, score double, ambiguous boolean"


def prediction(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """Struct column of lang_pred, score and ambiguous."""
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS x bits float32: at most a few MB

    @F.arrow_udf(PREDICTION)
    def of(texts: pa.Array) -> pa.Array:
        model = shipped.value
        lang, score, unsure = [], [], []
        for first, end, data, offsets in blocks(texts):
            letters = [x is not None and HAS_LETTER(x) is not None for x in texts.slice(first, end - first).to_pylist()]
            if model is None:
                lang, score, unsure = lang + ["und"] * len(letters), score + [0.0] * len(letters), unsure + [True] * len(letters)
                continue
            best, sure, close = model.decode(model.margins(data, offsets))
            lang += [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)]
            score += [s if ok else 0.0 for s, ok in zip(sure.tolist(), letters, strict=True)]
            unsure += [bool(c) or not ok for c, ok in zip(close.tolist(), letters, strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["lang_pred", "score", "ambiguous"])

    return of(text)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of doc_id and text."""
    return docs.select("doc_id", prediction(docs.sparkSession, model, F.col("text")).alias("_found")).select("doc_id", "_found.*")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
