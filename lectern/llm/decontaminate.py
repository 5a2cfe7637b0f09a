"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle sets (powers of two). For each partition a document's shingle
sequence is covered by windows of twice the partition's upper size, at half-window steps, so that an item's passage lies
whole in one window and containment becomes a Jaccard similarity that one-row MinHash bands find: with ``HASHES`` hashes an
item contained to 75 % is missed with a probability below (1 - 0.176) ** 40 < 0.0005. Every candidate is verified by exact
containment of the item's shingles in the whole document.

The items are broadcast if they take at most ``BROADCAST_BYTES``; beyond that, documents and items meet in a shuffle on the
signature, with the same result.

Defined results: null and empty texts, and items without words, match nothing; an item of fewer than five words matches only
texts that are that sequence; repeated items and documents give their rows once, those without an id rows of a null id; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.jaccard import WORDS, shingle_sets
from lectern.llm.storage import kept
from lectern.llm.text import U64, blocks, distinct, mix, shingles, signed, tidy, words

HASHES = 40
PERCENT = 75
#: Most bytes of items for the broadcast path: 8 for each word, 16 for each of an item's signatures.
BROADCAST_BYTES = 16 << 20
_rng = np.random.Generator(np.random.PCG64(77))
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U64(1)
SALTS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
HIT_SCHEMA = "doc_id long, item_id long, n_item int, n_shared int"


def size_class(n: int) -> int:
    return max(0, n.bit_length() - 1)


def signature(lows: np.ndarray, band: np.ndarray | int, part: int) -> np.ndarray:
    return mix(lows + U64(part * 1_000_003) + np.asarray(band, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def item_signatures(values: np.ndarray) -> np.ndarray:
    lows = ((values[None, :] ^ SALTS[:, None]) * FACTORS[:, None]).min(axis=1)
    return signature(lows, np.arange(HASHES), size_class(len(values)))


def window_signatures(made: np.ndarray, cut: np.ndarray, parts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, row of each) of all windows of a block of documents, hash by hash and size partition by partition."""
    count = np.diff(cut)
    for part in parts:
        step = 2 << part
        steps = -(-count // step)
        first = np.zeros(len(steps) + 1, dtype=np.int64)
        np.cumsum(steps, out=first[1:])
        if not first[-1]:
            continue
        row = np.repeat(np.arange(len(steps)), steps)
        begin = cut[:-1][row] + (np.arange(first[-1]) - first[row]) * step
        pair = np.flatnonzero(row[1:] == row[:-1])
        alone = np.flatnonzero(steps[row] == 1)
        owner = np.concatenate([row[pair], row[alone]])
        for k in range(HASHES):
            lows = np.minimum.reduceat((made ^ SALTS[k]) * FACTORS[k], begin)
            yield signature(np.concatenate([np.minimum(lows[pair], lows[pair + 1]), lows[alone]]), k, part), owner


def doc_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, _, data, offsets in blocks(column):
        hashes, _, _, at = words(data, offsets)
        made, cut = shingles(hashes, at, WORDS)
        yield first, made, cut


@dataclass
class Items:
    """All items' shingles and signatures, sorted by signature."""

    ids: list[int]
    sets: list[np.ndarray]
    signatures: np.ndarray
    owner: np.ndarray
    flags: np.ndarray
    parts: list[int]

    @staticmethod
    def of(rows: list[tuple[int, np.ndarray]]) -> Items:
        made = [item_signatures(v) for _, v in rows]
        all_of = np.concatenate(made) if made else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(m) for m in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(all_of, kind="stable")
        flags = np.zeros(1 << 20, dtype=bool)
        flags[(all_of >> U64(44)).astype(np.int64)] = True
        return Items([i for i, _ in rows], [v for _, v in rows], all_of[order], owner[order], flags, sorted({size_class(len(v)) for _, v in rows}))


def contained(values: np.ndarray, item: np.ndarray) -> int:
    """How many of an item's shingles a sorted set holds."""
    at = np.minimum(np.searchsorted(values, item), max(0, len(values) - 1))
    return int((values[at] == item).sum()) if len(values) else 0


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])


def _with_broadcast(docs: DataFrame, items: Items) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value
        for batch in batches:
            ids, out = batch.column(0), []
            for first, made, cut in doc_blocks(batch.column(1)):
                found: set[tuple[int, int]] = set()
                for signs, owner in window_signatures(made, cut, items.parts):
                    maybe = np.flatnonzero(items.flags[(signs >> U64(44)).astype(np.int64)])
                    if len(maybe):
                        low = np.searchsorted(items.signatures, signs[maybe])
                        high = np.searchsorted(items.signatures, signs[maybe], side="right")
                        for m in np.flatnonzero(high > low):
                            found.update((int(owner[maybe[m]]), int(k)) for k in items.owner[low[m] : high[m]])
                last, values = -1, np.zeros(0, np.uint64)
                for row, k in sorted(found):
                    if row != last:
                        last, values = row, distinct(made[cut[row] : cut[row + 1]])
                    n, shared = len(items.sets[k]), contained(values, items.sets[k])
                    if 100 * shared >= PERCENT * n:
                        out.append((ids[first + row].as_py(), items.ids[k], n, shared))
            if out:
                yield _hits(out)

    return docs.mapInArrow(tidy(run), HIT_SCHEMA).distinct()


def _with_shuffle(docs: DataFrame, bench: DataFrame) -> DataFrame:
    spark = docs.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in shingle_sets(batch.column(1)):
                if len(values):
                    own = item_signatures(values)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()), pa.array([size_class(len(values))] * len(own), pa.int32()), pa.array(signed(own))], names=["item_id", "part", "signature"])

    known = kept(spark, bench.mapInArrow(of_items, "item_id long, part int, signature long"))
    parts = sorted(r[0] for r in known.select("part").distinct().collect())  # at most 32 powers of two

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, made, cut in doc_blocks(batch.column(1)):
                for signs, owner in window_signatures(made, cut, parts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + first)), pa.array(signed(signs))], names=["doc_id", "signature"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (doc_id, item_id) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), strict=True)):
                values, item = (next(shingle_sets(batch.column(c).slice(i, 1)))[1] for c in ("text", "item_text"))
                shared = contained(values, item)
                if 100 * shared >= PERCENT * len(item):
                    out.append((doc_id, item_id, len(item), shared))
            yield _hits(out)

    pairs = docs.mapInArrow(of_docs, "doc_id long, signature long").join(known.select("item_id", "signature"), "signature").select("doc_id", "item_id").distinct()
    own, items = docs.withColumnRenamed("doc_id", "_doc"), bench.withColumnsRenamed({"text": "item_text", "item_id": "_item"})
    texts = pairs.join(own, F.col("doc_id").eqNullSafe(F.col("_doc"))).join(items, F.col("item_id").eqNullSafe(F.col("_item")))
    return texts.select("doc_id", "item_id", "text", "item_text").mapInArrow(verify, HIT_SCHEMA).distinct()


def contamination(docs: DataFrame, bench: DataFrame, most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document that holds an item to ``PERCENT``; equal rows stand once.

    Items of at most ``most_broadcast`` bytes are broadcast, more of them are shuffled, with the same rows.
    """
    docs, bench = docs.select("doc_id", "text"), bench.select("item_id", "text").where(F.col("text").isNotNull())
    size = bench.select(F.coalesce(F.sum(8 * F.size(F.split("text", r"\s+")) + 16 * HASHES), F.lit(0))).first()[0]
    if size <= most_broadcast:
        rows = [(r["item_id"], r["text"]) for r in bench.collect()]
        column = pa.array([t for _, t in rows], pa.string())
        hits = _with_broadcast(docs, Items.of([(rows[i][0], v) for i, v in shingle_sets(column) if len(v)]))
    else:
        hits = _with_shuffle(docs, bench)
    return hits.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
