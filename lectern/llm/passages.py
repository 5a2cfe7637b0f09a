"""Removal of repeated passages of words by compaction of the de Bruijn graph of their windows.

Every window of ``K`` words is an edge of the graph, from its first K - 1 words to its last. Only edges that occur twice matter,
and most of those follow one another in all their occurrences. They are compacted before anything moves, and again after:

* A window's minimizer is the leftmost smallest hash of its ``GRAM``-word grams. A stretch is a run of windows with one minimizer
  at one place; equal windows have equal minimizers, so a minimizer that occurs once takes its stretch out.
* Where all stretches of a minimizer are equal, the stretch is one piece of a path. Where they differ, each of its windows is a piece.
* Two repeated pieces join where the path doesn't branch: each occurs as often as the other, and the one is all that ever comes
  before the other. Such pieces occur side by side everywhere, so their source coordinates agree, which is verified; runs of them are
  the compacted paths, and the first occurrence of a path is the first of each of its windows.

What is removed is every occurrence of a path but the first. A window goes by two 64-bit hashes, its own and its minimizer's.
Bitmaps of bounded size keep windows back that can't match; where a corpus fills them, more rows move, with the same result.

Defined results: null or empty text has no words. Rows with an equal or no doc_id are documents of their own, in the order of
doc_id (none first), text hash; windows are judged on the input; overlaps count; an empty table gives an empty table. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bitmaps import bitmap, holds
from lectern.llm.lines import named
from lectern.llm.repeats import leftmost_smallest
from lectern.llm.storage import Scratch
from lectern.llm.text import blocks, powers, signed, tidy, window_hash, words

K, GRAM = 20, 8
STRETCHES = "core long, stretch long, head long, last long, before long, n int, row long, start int"
WINDOWS = "core long, id long, before long, row long, start int"
REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Edges:
    """The windows of a block: row, place in the row, hash, and the stretches that they form (first and last window, minimizer)."""

    def __init__(self, data: np.ndarray, rows: np.ndarray) -> None:
        hashes, _, _, first = words(data, rows, lower=False)
        n = len(hashes)
        if n < K:
            start = np.zeros(0, dtype=np.int64)
        else:
            self.prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(hashes * powers(n), out=self.prefix[1:])
            start = np.arange(n - K + 1)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(first))[: len(start)]
        inside = start + K <= first[row + 1]
        self.any = bool(inside.any())
        if not self.any:
            return
        at = np.arange(n - GRAM + 1)
        grams = window_hash(self.prefix, at, at + GRAM)
        place = leftmost_smallest(grams, K - GRAM + 1, len(start))[inside]
        self.start, self.row = start[inside], row[inside]
        self.place_in_row = self.start - first[self.row]
        self.hash = window_hash(self.prefix, self.start, self.start + K)
        cut = np.flatnonzero((place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])) + 1
        self.begin, self.end = np.concatenate([[0], cut]), np.append(cut, len(place)) - 1
        self.core = grams[place[self.begin]]

    def before(self, at: np.ndarray) -> np.ndarray:
        """Hash of the window before each of the given ones; 0 at the start of a row."""
        return np.where(self.place_in_row[at] > 0, self.hash[at - 1], 0)


def mapped(docs: DataFrame, row: str, schema: str, make: Callable[[Edges], tuple[np.ndarray, list[np.ndarray]] | None]) -> DataFrame:
    """Rows that ``make`` takes from each block's edges: indices of windows, and the columns before row and start."""
    names = [x.split()[0] for x in schema.split(", ")]
    ints = [x.endswith(" int") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, data, rows in blocks(batch.column(1)):
                edges = Edges(data, rows)
                if edges.any:
                    at, columns = make(edges)
                    columns = [pa.array(c.astype(np.int32) if small else signed(c)) for c, small in zip(columns, ints, strict=False)]
                    place = [batch.column(0).take(pa.array(edges.row[at] + first_row)), pa.array(edges.place_in_row[at].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *place][-len(names) :], names=names)

    return docs.select(row, "text").mapInArrow(tidy(run), schema)


def within(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indices begin[i] .. end[i]."""
    many = end - begin + 1
    return np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def pieces(docs: DataFrame, row: str, scratch: Scratch) -> DataFrame:
    """(core, id, last, n, times, at, before): repeated pieces of paths, with first and last window, windows, occurrences, first place (row, start) and the only window before, if there is one."""
    spark = docs.sparkSession
    cores = mapped(docs, row, "core long, row long, start int", lambda e: (e.begin, [e.core])).groupBy("core").agg(F.count("*").alias("n"))
    known = spark.sparkContext.broadcast(bitmap(scratch.keep(cores.where("n > 1").select("core"))))

    def stretches(e: Edges) -> tuple[np.ndarray, list[np.ndarray]]:
        use = np.flatnonzero(holds(known.value, e.core))
        a, b = e.begin[use], e.end[use]
        return a, [e.core[use], window_hash(e.prefix, e.start[a], e.start[b] + K), e.hash[a], e.hash[b], e.before(a), b - a + 1]

    place, only = F.min(F.struct("row", "start")).alias("at"), F.when(F.min("before") == F.max("before"), F.min("before")).alias("before")
    kinds = mapped(docs, row, STRETCHES, stretches).groupBy("core").agg(
        F.count("*").alias("times"), (F.min("stretch") < F.max("stretch")).alias("mixed"), F.min("head").alias("id"), F.min("last").alias("last"), F.min("n").cast("long").alias("n"), place, only
    )
    kinds = scratch.keep(kinds.where("times > 1"))
    known.destroy()
    mixed = kinds.where("mixed").select("core")
    split = spark.sparkContext.broadcast(bitmap(mixed))

    def windows(e: Edges) -> tuple[np.ndarray, list[np.ndarray]]:
        use = np.flatnonzero(holds(split.value, e.core))
        at = within(e.begin[use], e.end[use])
        return at, [np.repeat(e.core[use], e.end[use] - e.begin[use] + 1), e.hash[at], e.before(at)]

    single = mapped(docs, row, WINDOWS, windows).groupBy("core", "id").agg(F.count("*").alias("times"), place, only).where("times > 1").join(mixed, "core", "left_semi")
    columns = ["core", "id", "last", "n", "times", "at", "before"]
    single = single.withColumn("last", F.col("id")).withColumn("n", F.lit(1).cast("long"))
    out = scratch.keep(kinds.where("not mixed").select(*columns).unionByName(single.select(*columns)))
    split.destroy()
    scratch.drop(kinds)
    return out


def paths(docs: DataFrame, row: str, scratch: Scratch) -> DataFrame:
    """(core, id, row, start, n, times): compacted paths of repeated windows, named by their first window, with first place, windows and occurrences."""
    found = pieces(docs, row, scratch).select("core", "id", "last", "n", "times", F.col("at.row").alias("row"), F.col("at.start").cast("long").alias("start"), "before")
    # a piece goes on from another where neither has another neighbour on that side and their coordinates agree
    prior = found.select(F.col("last").alias("before"), "times", "row", (F.col("start") + F.col("n")).alias("start"), F.lit(1).alias("goes_on"))
    linked = found.join(prior, ["before", "times", "row", "start"], "left")
    own = Window.partitionBy("row").orderBy("start")  # the pieces of one text
    runs = linked.withColumn("run", F.sum(F.when(F.col("goes_on").isNull(), 1).otherwise(0)).over(own))
    heads = runs.groupBy("row", "run").agg(F.min_by(F.struct("core", "id"), "start").alias("head"), F.min("start").alias("start"), F.sum("n").alias("n"), F.max("times").alias("times"))
    return scratch.keep(heads.select("head.core", "head.id", "row", "start", "n", "times"))


def repeats(docs: DataFrame, row: str, scratch: Scratch) -> DataFrame:
    """(row, start, n, first_row, first_start): occurrences of paths but the first; ``n`` words from word ``start`` on."""
    found = paths(docs, row, scratch)
    known = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("id")))

    def hits(e: Edges) -> tuple[np.ndarray, list[np.ndarray]]:
        at = np.flatnonzero(holds(known.value, e.hash))
        return at, [e.core[np.searchsorted(e.begin, at, side="right") - 1], e.hash[at]]

    first = found.select("core", "id", F.col("row").alias("first_row"), F.col("start").alias("first_start"), "n")
    met = mapped(docs, row, "core long, id long, row long, start int", hits).join(first, ["core", "id"])
    later = met.where("row <> first_row or start <> first_start")
    return later.select("row", "start", (F.col("n") + K - 1).cast("int").alias("n"), "first_row", "first_start")


def remove(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: words, removed words, digest of the words that stay, and these (null unless ``with_text``)."""
    scratch = Scratch(docs.sparkSession)
    docs, row = named(docs.select("doc_id", "text"), scratch)
    spans = repeats(docs, row, scratch).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # at most a text's windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, end_row, data, rows in blocks(batch.column(1)):
                _, starts, ends, first = words(data, rows, lower=False)
                part = batch.column(2).slice(first_row, end_row - first_row)
                whole, many = part.flatten(), np.array(part.value_lengths().fill_null(0), dtype=np.int64)
                begin = whole.field(0).to_numpy() + np.repeat(first[:-1], many)
                depth = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + whole.field(1).to_numpy(), -1)
                stays = np.cumsum(depth)[:-1] == 0
                gone = np.concatenate([[0], np.cumsum(~stays)])
                raw, left = data.tobytes(), []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    keep = np.flatnonzero(stays[a:b]) + a
                    left.append(b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
                text = pa.array([x.decode() if with_text else None for x in left], pa.string())
                counts = (pa.array(x) for x in (np.diff(first), gone[first[1:]] - gone[first[:-1]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first_row, end_row - first_row), *counts, pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), text], names=[x.split()[0] for x in REMOVED.split(", ")])

    met = docs.join(spans.withColumnRenamed("row", row) if row != "row" else spans, row, "left")
    return met.select("doc_id", "text", "spans").mapInArrow(tidy(run), REMOVED)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
