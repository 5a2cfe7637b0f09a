"""Toxic passages as maximal scoring segments over token log-odds.

Token scores are log-odds between toxic and clean training rows with an informative Dirichlet prior; a row counts a token once,
so that one row that repeats a word doesn't make it toxic. Tokens without a significant score share a small negative drift. One linear pass per document finds all maximal scoring segments; their scores
are normalised by extreme-value statistics (Karlin-Altschul lambda solved from the clean token distribution, K estimated from
clean training documents); the best one to ``COMBINED`` give one tail probability, which is calibrated to a probability of
label 1. (Held-out rows of check_s, by a numpy form of the same steps: 49 errors of 4061 with the best one alone, 32 with three,
110 with all.)

The model is fitted on a sample of at most about ``SAMPLE`` labelled documents (all, if there are no more), taken by a hash of
doc_id. K and the calibration are fitted out of fold: on documents scored by a model of the other folds.

Defined results: null or empty text has no segments and gets the calibrated score of evidence 0; repeated labels of a
document all count, and so do repeated rows of it; null labels and labels of a null doc_id don't train; without training rows
of both labels every score is the share of label 1 (0 if there is none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import Scratch
from lectern.llm.text import IS_BREAK, U64, blocks, tidy, words

#: Most labelled documents that train the model, on the average; their ids and labels (24 bytes each) are broadcast.
SAMPLE = 100_000
#: Hash buckets of tokens: the model is this many float32, whatever the corpus holds.
BUCKETS = 1 << 18
#: Weight of the prior in tokens, least z for a token to count, bounds of a token's score, drift of the others.
PRIOR, LEAST_Z, MOST, DRIFT = 5_000.0, 3.5, 8.0, -0.5
#: Folds of the calibration: few would calibrate models of much less data than the one that is used.
FOLDS = 5
#: Segments that are summed at most; ``n_segments`` and ``passages`` know all.
COMBINED = 3
#: Bins of log(1 + evidence) for the calibration and their upper end.
BINS, TOP = 400, 10.0
FEATURE_SCHEMA = "doc_id long, evidence double, n_segments int, best_start int, best_end int, best_bits double"
SEGMENT_SCHEMA = "doc_id long, start int, end int, bits double, evalue double, passage string"


def buckets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, start and end of each token, and each row's first token."""
    hashes, starts, ends, first = words(data, rows, breaks=IS_BREAK)
    return (hashes >> U64(46)).astype(np.int64), starts, ends, first


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end token, score) of a sequence of token scores, in order.

    Linear time: candidates lie on a stack with the sums before and up to each and a link to the nearest one whose sum before
    it is smaller. A candidate that can extend that one to a larger sum takes it in, with all between.
    """
    prefix = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    hits = np.flatnonzero(scores > 0)
    begins: list[int] = []
    ends: list[int] = []
    lefts: list[float] = []
    rights: list[float] = []
    links: list[int] = []
    for position, left, right in zip(hits.tolist(), prefix[hits].tolist(), prefix[hits + 1].tolist(), strict=True):
        begin, j = position, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = links[j]
            if j < 0 or rights[j] >= right:
                break
            begin, left, link = begins[j], lefts[j], links[j]
            for held in (begins, ends, lefts, rights, links):
                del held[j:]
            j = link
        for held, value in zip((begins, ends, lefts, rights, links), (begin, position + 1, left, right, j), strict=True):
            held.append(value)
    return [(b, e, r - left) for b, e, left, r in zip(begins, ends, lefts, rights, strict=True)]


@dataclass
class Model:
    """Scores by bucket, the decay rate of their maximal segments in clean text, and how many of those a token begins."""

    scores: np.ndarray
    rate: float
    k: float = 0.1


def evidence(scaled: np.ndarray, n: int, k: float) -> tuple[float, int]:
    """Minus log of the tail probability of the segments of n tokens, and how many segments are significant.

    ``scaled`` are rate times score. For each r, the sum of the r best normalised scores has a known tail; the least counts.
    """
    norm = np.sort(scaled)[::-1] - np.log(max(k * n, 1e-9))
    norm = norm[norm > 0]
    if not len(norm):
        return 0.0, 0
    total = np.cumsum(norm[:COMBINED])
    r = np.arange(1, len(total) + 1)
    factorials = np.cumsum(np.log(r))  # log r!
    log_p = -total + (r - 1) * np.log(total + 1) - factorials - np.array([lgamma(x) for x in r])
    return max(0.0, -float(log_p.min())), int((norm > 3).sum())


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, clean, toxic, fold) for the sampled labelled documents: counts of their labels, and a fold by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.sum((F.col("toxic") == 0).cast("long")).alias("clean"), F.sum((F.col("toxic") != 0).cast("long")).alias("toxic"))
    share = min(1.0, 0.95 * SAMPLE / max(known.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return known.where(place < int(share * (1 << 30)) + 1).withColumn("fold", (F.shiftright(place, 7) % FOLDS).cast("int"))


def train(rows: DataFrame) -> list[Model | None]:
    """Models of all rows but each fold's, and last of all rows, of ``fold, clean, toxic, text``; only bucket counts reach the driver.

    A bucket's count is the number of rows that hold it.
    """
    names = [f"c{k}" for k in range(2 * FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2 * FOLDS, BUCKETS), dtype=np.int64)
        for batch in batches:
            fold, clean, toxic = (batch.column(k).to_numpy() for k in range(3))
            for first, end, data, offsets in blocks(batch.column(3)):
                bucket, _, _, at = buckets(data, offsets)
                pairs = np.unique(np.repeat(np.arange(first, end), np.diff(at)) * BUCKETS + bucket)
                own, bucket = pairs // BUCKETS, pairs % BUCKETS
                for kind, weight in enumerate((clean, toxic)):
                    for part in range(FOLDS):
                        mine = (fold[own] == part) & (weight[own] > 0)
                        held[2 * part + kind] += np.bincount(bucket[mine], weights=weight[own[mine]], minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(h[used]) for h in held)], names=["bucket", *names])

    found = rows.select("fold", "clean", "toxic", "text").mapInArrow(tidy(count), ", ".join(["bucket long", *(f"{x} long" for x in names)]))
    table = found.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # at most BUCKETS rows
    counts = np.zeros((2 * FOLDS, BUCKETS))
    for i, x in enumerate(names):
        counts[i, table["bucket"]] = table[x]
    counts = counts.reshape(FOLDS, 2, BUCKETS)
    total = counts.sum(axis=0)
    return [*(fit(total - own) for own in counts), fit(total)]


def fit(counts: np.ndarray) -> Model | None:
    """Log-odds with a Dirichlet prior in proportion to the overall counts."""
    totals = counts.sum(axis=1)
    if not totals.all():
        return None
    prior = PRIOR * (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * BUCKETS)
    weight = counts + prior
    odds = np.log(weight) - np.log(totals[:, None] + PRIOR - weight)
    delta = odds[1] - odds[0]
    z = delta / np.sqrt((1 / weight).sum(axis=0))
    scores = np.where((z > LEAST_Z) & (delta > 1.0), np.minimum(delta, MOST), np.where(z < -LEAST_Z, np.clip(delta, -MOST, DRIFT), DRIFT))
    clean = (counts[0] + 0.01) / (counts[0] + 0.01).sum()
    low, high = 1e-3, 5.0
    for _ in range(60):  # the rate at which sum(p * exp(rate * score)) is 1
        mid = (low + high) / 2
        low, high = (mid, high) if (clean * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return Model(scores.astype(np.float32), low)


def _scan(column: pa.Array, model: Model | None) -> Iterator[tuple]:
    """(text bytes, token starts, token ends, segments) of each row."""
    for _, _, data, offsets in blocks(column):
        bucket, starts, ends, at = buckets(data, offsets)
        score = model.scores[bucket] if model is not None else np.zeros(len(bucket), np.float32)
        some = np.searchsorted(np.flatnonzero(score > 0), at)
        for k in range(len(offsets) - 1):
            found = segments(score[at[k] : at[k + 1]]) if some[k + 1] > some[k] else []
            yield data[offsets[k] : offsets[k + 1]], starts[at[k] : at[k + 1]] - offsets[k], ends[at[k] : at[k + 1]] - offsets[k], found


def out_of_fold(rows: DataFrame, others: list[Model | None]) -> DataFrame:
    """(clean, toxic, tokens, scaled) of training rows: their segments' scores under the model of the other folds."""
    shipped = rows.sparkSession.sparkContext.broadcast(others)  # 1 MB a fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, model in enumerate(shipped.value):
                own = batch.filter(pa.array(batch.column(0).to_numpy() == part))
                made = [(len(starts), [model.rate * s for _, _, s in found] if model else []) for _, starts, _, found in _scan(own.column(3), model)] if own.num_rows else []
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array([n for n, _ in made], pa.int32()), pa.array([x for _, x in made], pa.list_(pa.float64()))], names=["clean", "toxic", "tokens", "scaled"])

    return rows.select("fold", "clean", "toxic", "text").mapInArrow(tidy(run), "clean long, toxic long, tokens int, scaled array<double>")


def starting_rate(rows: DataFrame) -> float:
    """K by maximum likelihood from the best segments of clean rows (clean, tokens, scaled)."""
    best = F.coalesce(F.array_max("scaled"), F.lit(0.0))
    r = rows.where("clean > 0 and tokens > 0").agg(F.sum("clean").alias("n"), F.sum(F.col("clean") * F.col("tokens") * F.exp(-best)).alias("room")).first()
    return float(min(1.0, max(1e-4, r["n"] / r["room"]))) if r["n"] and r["room"] else 0.1


def features(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: combined evidence, number of significant segments, byte range and bits of the best one (-1: none)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS float32: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            rows = []
            for doc_id, (_, starts, ends, found) in zip(batch.column(0).to_pylist(), _scan(batch.column(1), model), strict=True):
                total, n = evidence(np.array([model.rate * s for _, _, s in found]), len(starts), model.k) if found else (0.0, 0)
                top = max(found, key=lambda x: (x[2], -x[0]), default=None)
                rows.append((doc_id, total, n, int(starts[top[0]]) if top else -1, int(ends[top[1] - 1]) if top else -1, top[2] if top else 0.0))
            if rows:
                yield _pack(rows)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), FEATURE_SCHEMA)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])


def passages(docs: DataFrame, model: Model | None, most_evalue: float = 0.05) -> DataFrame:
    """Every significant toxic passage: byte range, score, expected number by chance, text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            rows = []
            for doc_id, (data, starts, ends, found) in zip(batch.column(0).to_pylist(), _scan(batch.column(1), model), strict=True):
                for b, e, s in found:
                    chance = float(model.k * len(starts) * np.exp(-model.rate * s))
                    if chance <= most_evalue:
                        rows.append({"doc_id": doc_id, "start": int(starts[b]), "end": int(ends[e - 1]), "bits": s, "evalue": chance, "passage": data[starts[b] : ends[e - 1]].tobytes().decode()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64()), ("evalue", pa.float64()), ("passage", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SEGMENT_SCHEMA)


def calibrate(rows: DataFrame, k: float) -> tuple[float, float]:
    """Offset and slope of a logistic curve from evidence to label, fitted on all rows (clean, toxic, tokens, scaled) by bins."""

    @F.arrow_udf("double")
    def of(scaled: pa.Array, tokens: pa.Array) -> pa.Array:
        return pa.array([evidence(np.array(s or [], dtype=np.float64), n, k)[0] for s, n in zip(scaled.to_pylist(), tokens.to_pylist(), strict=True)], pa.float64())

    at = F.floor(F.least(F.log1p(of("scaled", "tokens")), F.lit(TOP)) / TOP * (BINS - 1)).cast("int")
    table = rows.groupBy(at.alias("bin")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()  # at most BINS rows
    x = np.array([r["bin"] * TOP / (BINS - 1) for r in table for _ in range(2)])
    y, w = np.array([float(i) for _ in table for i in range(2)]), np.array([float(r[kind]) for r in table for kind in ("clean", "toxic")])
    if not w.sum():
        return -30.0, 0.0
    share = (w * y).sum() / w.sum()
    if share in (0.0, 1.0):
        return (-30.0 if share == 0 else 30.0), 0.0
    a, b = float(np.log(share / (1 - share))), 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - 0.1 * b])
        h = w * p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[h.sum() + 0.01, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.1]]), g)
        a, b = a + float(np.clip(step[0], -2, 2)), max(0.0, b + float(np.clip(step[1], -2, 2)))
    return a, b


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float, float]:
    """The model, and offset and slope of its calibration, from all labels given."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.keep(training(docs, labels))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about SAMPLE rows of 24 bytes at most
    *others, model = train(rows)
    tried = scratch.keep(out_of_fold(rows, others))
    k = starting_rate(tried)
    a, b = calibrate(tried, k)
    scratch.only()
    if model is not None:
        model.k = k
    return model, a, b


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from the labelled ones that aren't held out."""
    model, a, b = learn(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(F.log1p("evidence"), F.lit(TOP)))))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return features(docs, model).withColumn("score", p).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "n_segments", "best_start", "best_end")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
