"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut the corpus into phrases: the trigger of a window start is the leftmost smallest 16-byte rolling hash
in the next ``REACH`` positions, so that any two equal strings of ``LENGTH`` bytes have the same trigger inside, at the same
offset. A phrase is the bytes that the windows with one trigger cover. The dictionary is the set of distinct phrases, named by
two 64-bit hashes, and the parse is their sequence; both are shuffled tables, documents are never laid end to end and no
string crosses a document.

A phrase that occurs twice in the parse repeats whole. Where two different phrases share the bytes after their trigger, their
windows are compared themselves, once per distinct phrase. That is the equality that the corpus's suffix order would show
between neighbours (a common prefix of at least ``LENGTH``); ranks are replaced by hash names, because a global suffix order
needs the dictionary in one place.

Besides, ``shares_passage`` says which documents hold a passage of over 50 words that another document holds, too. That is the same
parse over words instead of bytes: triggers cut the words into phrases, and where phrases with equal cores differ, their
windows of 51 words are compared.

Defined results: null text counts as empty; texts under ``LENGTH`` bytes lose nothing; overlapping occurrences in one
document count; strings are judged on the input; extra columns are ignored. Rows with an equal or no doc_id are documents of
their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bitmaps import bitmap, holds
from lectern.llm.lines import named
from lectern.llm.storage import Scratch
from lectern.llm.text import U64, blocks, powers, rolling, signed, tidy, window_hash, words

LENGTH, GRAM, REACH = 400, 16, 192
#: Bytes from the trigger on that every window with this trigger holds.
SHARED = LENGTH - REACH + 1
#: A passage's words, the words of its triggers, and where in it these may begin.
PASSAGE, GRAM_WORDS = 51, 12
REACH_WORDS = PASSAGE - GRAM_WORDS + 1
#: Kinds of phrases that a task remembers, to show the windows of equal ones once.
SEEN = 1 << 18
#: Windows of a phrase are first compared in runs of this many, aligned to the trigger.
RUN = 16
PHRASE = "doc_id long, first long, n int, after long, phrase long, trigger long"
RUNS = "after long, core long, head binary, tail binary, doc_id long, first long, n int, shift int"
DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage int, kept binary"


def leftmost_smallest(hashes: np.ndarray, reach: int, n: int) -> np.ndarray:
    """For starts 0 .. n - 1 the position of the leftmost smallest hash (of its upper half) among the next ``reach``."""
    key = (hashes >> U64(32) << U64(32)) | np.arange(len(hashes)).astype(np.uint64)
    size = -(-len(key) // reach) * reach
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.arange(n)
    return (np.minimum(behind[start], ahead[start + reach - 1]) & U64(0xFFFFFFFF)).astype(np.int64)


def triggers(prefix: np.ndarray, n: int) -> np.ndarray:
    """Trigger position of every window start 0 .. n - LENGTH of a block, document borders aside."""
    at = np.arange(n - GRAM + 1)
    return leftmost_smallest(window_hash(prefix, at, at + GRAM), REACH, n - LENGTH + 1)


def parse(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first window start, last window start, trigger and the two hashes of each phrase of a block."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = rolling(data)
    trigger = triggers(prefix, len(data))
    start = np.arange(len(trigger))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(trigger)]
    inside = start + LENGTH <= rows[row + 1]
    start, trigger, row = start[inside], trigger[inside], row[inside]
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])) + 1
    begin, end = np.concatenate([[0], cut]), np.append(cut, len(start)) - 1
    first, last, own = start[begin], start[end], trigger[begin]
    return row[begin], first, last, own, window_hash(prefix, own, own + SHARED), window_hash(prefix, first, last + LENGTH)


def phrases(docs: DataFrame) -> DataFrame:
    """The parse: (doc_id, first window start, windows, hash after the trigger, hash of the phrase, trigger)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, data, rows in blocks(batch.column(1)):
                row, first, last, trigger, after, phrase = parse(data, rows)
                if len(row):
                    base = rows[row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first_row)), pa.array(first - base), pa.array((last - first + 1).astype(np.int32)), pa.array(signed(after)), pa.array(signed(phrase)), pa.array(trigger - base)], names=["doc_id", "first", "n", "after", "phrase", "trigger"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PHRASE)


def runs_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs of windows of the wanted phrases (doc_id, first, n, after, trigger): up to ``RUN`` starts, aligned to the trigger.

    ``core`` names the bytes that all windows of an untruncated run hold; ``head`` are the run's bytes before the core from
    its first window on, ``tail`` those after it up to its last window's end. Equal windows lie in runs with equal cores.
    """
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "after", "trigger")).alias("stretches"))  # at most a document's phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                part = batch.column(2).slice(i, 1).flatten()
                first, n, after, trigger = (part.field(k).to_numpy().astype(np.int64) for k in range(4))
                step = (first - trigger) // RUN
                many = (first + n - 1 - trigger) // RUN - step + 1
                own = np.repeat(np.arange(len(first)), many)
                base = trigger[own] + (step[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * RUN
                begin, end = np.maximum(first[own], base), np.minimum(first[own] + n[own], base + RUN)
                core = window_hash(rolling(np.frombuffer(raw, np.uint8)), base + RUN - 1, base + LENGTH) + (base - trigger[own]).view(np.uint64)
                head = [raw[a : b + RUN - 1] for a, b in zip(begin.tolist(), base.tolist(), strict=True)]
                tail = [raw[b + LENGTH : e - 1 + LENGTH] for b, e in zip(base.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(after[own]), pa.array(signed(core)), pa.array(head, pa.binary()), pa.array(tail, pa.binary()), pa.array(np.full(len(own), batch.column(0)[i].as_py())), pa.array(begin), pa.array((end - begin).astype(np.int32)), pa.array((begin - base).astype(np.int32))], names=["after", "core", "head", "tail", "doc_id", "first", "n", "shift"])

    return docs.select("doc_id", "text").join(by_doc, "doc_id").select("doc_id", "text", "stretches").mapInArrow(tidy(run), RUNS)


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, first, n): runs of window starts whose ``LENGTH`` bytes also start elsewhere."""
    near, same = Window.partitionBy("after"), Window.partitionBy("after", "phrase")
    # phrases that share the bytes after their trigger with another occurrence; the others hold no repeated window
    met = phrases(docs).withColumn("near", F.count("*").over(near)).where("near > 1")
    met = met.withColumn("times", F.count("*").over(same)).withColumn("least", F.min("times").over(near)).withColumn("k", F.row_number().over(same.orderBy("doc_id", "first")))
    met = scratch.keep(met.where("times > 1 or near > times").select("doc_id", "first", "n", "after", "trigger", "times", "least", "k"))
    whole = met.where("times > 1").select("doc_id", "first", "n")
    # one phrase of each kind, where some kind occurs once
    runs = scratch.keep(runs_of(docs, met.where("k = 1 and least = 1")))
    equal = Window.partitionBy("after", "core", "head", "tail", "shift")
    cores = runs.withColumn("near", F.count("*").over(Window.partitionBy("after", "core"))).where("near > 1").withColumn("times", F.count("*").over(equal)).withColumn("k", F.row_number().over(equal.orderBy("doc_id", "first")))
    cores = scratch.keep(cores)
    scratch.drop(runs)
    equal_runs = cores.where("times > 1").select("doc_id", "first", "n")
    # window by window: what a window holds before and after the core
    window = cores.where("k = 1 and near > times").select("after", "core", "head", "tail", "doc_id", "first", "shift", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    place = F.col("shift") + F.col("i")
    before = F.expr("substring(head, i + 1)")
    behind = F.expr("substring(tail, 1, shift + i)")
    named = window.select("after", "core", place.alias("place"), before.alias("before"), behind.alias("behind"), "doc_id", (F.col("first") + F.col("i")).alias("first"))
    alike = named.withColumn("times", F.count("*").over(Window.partitionBy("after", "core", "place", "before", "behind"))).where("times > 1")
    return whole.unionByName(equal_runs).unionByName(alike.select("doc_id", "first", F.lit(1).alias("n")))


def word_phrases(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Row, first and last window start (in words), hashes of core and phrase of each phrase of words, and the words' prefix sums."""
    hashes, _, _, first = words(data, rows)
    n = len(hashes)
    if n < PASSAGE:
        return None
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(n), out=prefix[1:])
    at = np.arange(n - GRAM_WORDS + 1)
    trigger = leftmost_smallest(window_hash(prefix, at, at + GRAM_WORDS), REACH_WORDS, n - PASSAGE + 1)
    start = np.arange(len(trigger))
    row = np.searchsorted(first, start, side="right") - 1
    inside = start + PASSAGE <= first[row + 1]
    start, trigger, row = start[inside], trigger[inside], row[inside]
    if not len(start):
        return None
    cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])) + 1
    begin, end = np.concatenate([[0], cut]), np.append(cut, len(start)) - 1
    own = trigger[begin]
    return row[begin], start[begin], start[end], window_hash(prefix, own, own + GRAM_WORDS), window_hash(prefix, start[begin], start[end] + PASSAGE), prefix


def sharing(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id) of the documents with a passage of ``PASSAGE`` words that a document of another id holds."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, data, rows in blocks(batch.column(1)):
                if (found := word_phrases(data, rows)) is not None:
                    row, _, _, core, phrase, _ = found
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first_row)), pa.array(signed(core)), pa.array(signed(phrase))], names=["doc_id", "core", "phrase"])

    docs = docs.where("doc_id is not null").select("doc_id", "text")
    ends = (F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    kinds = scratch.keep(docs.mapInArrow(tidy(cores), "doc_id long, core long, phrase long").groupBy("core", "phrase").agg(*ends))
    known = kinds.groupBy("core").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("core")
    whole = kinds.where("low < high").select("phrase")
    shipped = docs.sparkSession.sparkContext.broadcast((bitmap(known), bitmap(whole)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, whole = shipped.value
        seen: set[int] = set()
        for batch in batches:
            for first_row, _, data, rows in blocks(batch.column(1)):
                if (found := word_phrases(data, rows)) is None:
                    continue
                row, first, last, core, phrase, prefix = found
                some = holds(known, core)
                repeated = some & holds(whole, phrase)
                # documents with a repeated phrase; of its windows one show in a task is enough
                fresh = np.zeros(len(row), dtype=bool)
                for k in np.flatnonzero(repeated).tolist():
                    fresh[k] = int(phrase[k]) not in seen
                    seen.add(int(phrase[k]))
                if len(seen) > SEEN:
                    seen.clear()
                use = np.flatnonzero((some & ~repeated) | fresh)
                many = last[use] - first[use] + 1
                start = np.repeat(first[use], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                ids = batch.column(0).take(pa.array(np.concatenate([row[repeated], np.repeat(row[use], many)]) + first_row))
                hashes = np.concatenate([phrase[repeated], window_hash(prefix, start, start + PASSAGE)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(hashes))], names=["doc_id", "hash"])

    # as they are made: a document's equal windows are few, and need no shuffle of all windows to be dropped
    shown = scratch.keep(docs.mapInArrow(tidy(windows), "doc_id long, hash long"))
    twice = shown.groupBy("hash").agg(*ends).where("low < high").select("hash")
    out = scratch.keep(shown.join(twice, "hash", "left_semi").select("doc_id").distinct())
    scratch.drop(kinds, shown)
    return out


def remove(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, digest of what is kept, 1 if it shares a passage, and what is kept."""
    scratch = Scratch(docs.sparkSession)
    docs, row = named(docs.select("doc_id", "text"), scratch)
    if row != "doc_id":
        out = removed(docs.select(F.col(row).alias("doc_id"), "text"), scratch)
        return out.join(docs.select(F.col(row).alias("_row"), F.col("doc_id").alias("_own")), F.col("doc_id") == F.col("_row")).withColumn("doc_id", F.col("_own")).drop("_row", "_own")
    return removed(docs, scratch)


def removed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``remove`` for rows with ids of their own."""
    by_doc = repeated(docs, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("starts"))  # at most a document's windows
    by_doc = by_doc.join(sharing(docs, scratch).withColumn("shares", F.lit(1)), "doc_id", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                part = batch.column(2).slice(i, 1).flatten()
                removed = spans = 0
                left = raw
                if len(part):
                    first, n = (part.field(k).to_numpy().astype(np.int64) for k in range(2))
                    depth = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + n - 1 + LENGTH, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    removed, spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(raw)], pa.int64()), pa.array([removed], pa.int64()), pa.array([spans], pa.int64()), pa.array([hashlib.sha256(left).hexdigest()]), pa.array([batch.column(3)[i].as_py() or 0], pa.int32()), pa.array([left], pa.binary())], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return docs.select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", "text", "starts", "shares").mapInArrow(tidy(run), DIGEST_SCHEMA)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept")
