"""N-gram Jaccard join of documents by PartEnum signatures.

Two sets with sizes in one band and Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) of their summed
sizes, h features. The feature domain (shingle hashes) is cut into n1 = h // 2 + 1 first-level partitions and each of those into
``PARTS`` = 3 second-level ones. Some first-level partition holds at most one difference; so of its subsets of two second-level
partitions one is equal in both sets. All subsets of all first-level partitions are enumerated; a subset with its content is a
signature. Where a set cannot use up all h differences, more subsets are shared for certain, and it shows only as many as
are needed to meet one of them: the rarest under an order that is the same for all (a count sketch of fixed size over all
documents; subsets without content last).

Sets that share a signature are first compared with one of them, the lead with which they share most; what this links is one
component. Then the sets that met one lead in any signature are one group, so that sets that share many signatures meet once and
not in each, and within each group all sets of different components are compared: sizes and parity bitmaps of 4 to 8 bits a
shingle bound their difference from below, and what passes, little under the threshold at worst, is verified on the exact
shingle sets. Large groups are dealt to several tasks as pairs of blocks. Shingles are compared by 64-bit hashes; two of m distinct shingles collide with odds of m^2 / 2^65.

Defined results: null text, empty text and text without words have no shingles and link with nothing; a text of fewer than
five words has its whole sequence as one shingle; equal sets link; rows with one doc_id count as documents of their own with
that id; rows without a doc_id take the component of an equal set, if it has one, and link nothing else; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bitmaps import Parities, bitmap, holds
from lectern.llm.graph import components
from lectern.llm.sketch import packed, rarity
from lectern.llm.storage import Scratch
from lectern.llm.text import U64, blocks, distinct, mix, shingles, signed, tidy, words

WORDS = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Second-level partitions of a first-level one; subsets leave one of them out.
PARTS = 3
#: Buckets of the count sketch that orders signatures by rarity: 8 MB of counts, whatever the corpus holds.
BUCKETS = 1 << 22
#: Sets of a lead that are compared in one task, and bytes of their parities; larger groups are dealt out as pairs of blocks of about this size.
BLOCK, BLOCK_BYTES = 2048, 1 << 23
#: Partners of a set that are verified in one task.
PARTNERS = 512
#: A parity has this times n to 2 n bits: at 4, sets of equal size with a Jaccard similarity under 0.73 seldom pass for similar.
WIDE = 4
#: Names of shown sets that a task remembers, to show equal sets once.
SEEN = 1 << 18
SET_SCHEMA = "doc_id long, mark long, n int, h1 long, h2 long, parity binary, sketch binary"


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for first, _, data, offsets in blocks(column):
        hashes, _, _, at = words(data, offsets)
        made, cut = shingles(hashes, at, WORDS)
        for k in range(len(offsets) - 1):
            yield first + k, distinct(made[cut[k] : cut[k + 1]])


def most_different(size: int, band: int, percent: int = PERCENT) -> int:
    """Most features in which a set of ``size`` can differ from a similar one, the larger of both being of ``band``."""
    partner = min(size * 100 // percent, (2 << band) - 1)
    return (size + partner) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int = PERCENT) -> range:
    """Bands that may hold the larger set of a similar pair with a set of ``size``."""
    return range(size.bit_length() - 1, (size * 100 // percent).bit_length())


def partitions(band: int, percent: int = PERCENT) -> int:
    """First-level partitions for the sets of a band: more than half of what two of them can differ in."""
    return (2 * ((2 << band) - 1) * (100 - percent) // (100 + percent)) // 2 + 1


def shared_for_certain(n1: int, most: int) -> int:
    """Subsets that two sets share at least if they differ in ``most`` features: the first difference in a first-level partition
    costs two of its three subsets, the second, in another part, the last one."""
    return PARTS * n1 - 2 * min(most, n1) - min(max(most - n1, 0), n1)


def signatures(values: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set (sorted hashes) in a band, and which of them stand for a subset without content."""
    n1 = partitions(band)
    m = PARTS * n1
    part = ((values >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content, filled = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=np.int8)
    content[part[begin]] = np.add.reduceat(mix(values), begin)
    filled[part[begin]] = 1
    content, filled = content.reshape(n1, PARTS), filled.reshape(n1, PARTS)
    rest = (content.sum(axis=1, dtype=np.uint64)[:, None] - content).ravel()
    none = (filled.sum(axis=1)[:, None] == filled).ravel()
    return mix(rest + np.arange(m, dtype=np.uint64) * U64(0xD6E8FEB86659FD93) + U64(band)), none


def shown(values: np.ndarray, band: int, counts: np.ndarray) -> np.ndarray:
    """The signatures that a set shows in a band: those that meet one of any similar set's, rarest first."""
    own, none = signatures(values, band)
    k = len(own) - shared_for_certain(len(own) // PARTS, most_different(len(values), band)) + 1
    if k >= len(own):
        return own
    rank = np.where(none, np.int64(1 << 40), counts[bucket(own)].astype(np.int64))
    return own[np.lexsort((own, rank))[:k]]


def bucket(signature: np.ndarray) -> np.ndarray:
    return (signature >> U64(42)).astype(np.int64)


def parity(values: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number of them has it; ``WIDE`` times n to 2 n bits, 64 at least."""
    m = max(64, WIDE << len(values).bit_length())
    return np.packbits(np.bincount((values & U64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def least_different(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their parities; the longer one is folded."""
    x, y = (np.frombuffer(p, np.uint8) for p in (a, b))
    while len(x) != len(y):
        x, y = (y, x) if len(x) < len(y) else (x, y)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_rows(docs: DataFrame) -> DataFrame:
    """Size, two hashes and parity of every document's set, and from each task one row with the sketch of its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            n, h1, h2, odd = [], [], [], []
            made: list[np.ndarray] = []
            for _, values in shingle_sets(batch.column(2)):
                n.append(len(values))
                odd.append(parity(values) if len(values) else None)
                h1.append(int(mix(values).sum(dtype=np.uint64)) if len(values) else 0)
                h2.append(int(mix(values ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) if len(values) else 0)
                made += [signatures(values, band)[0] for band in bands(len(values))] if len(values) else []
                if len(made) >= 256:
                    np.add.at(counts, bucket(np.concatenate(made)), 1)
                    made = []
            if made:
                np.add.at(counts, bucket(np.concatenate(made)), 1)
            yield _set_batch(batch.column(0), batch.column(1), n, h1, h2, odd, [None] * len(n))
        yield _set_batch(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [0], [0], [0], [None], [packed(counts)])

    return marked(docs).mapInArrow(tidy(run), SET_SCHEMA)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, hash of the text, text): what tells rows with one doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _set_batch(doc_id: pa.Array, mark: pa.Array, n: list, h1: list, h2: list, odd: list, sketch: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in SET_SCHEMA.split(", ")]
    hashes = [pa.array(signed(np.array(h, np.uint64))) for h in (h1, h2)]
    return pa.RecordBatch.from_arrays([doc_id, mark, pa.array(n, pa.int32()), *hashes, *(pa.array(x, pa.binary()) for x in (odd, sketch))], names=names)


def signature_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(signature, name): the signatures that each set shows; a task shows equal sets once, or seldom more often. A set's name is its first hash."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shipped.value, set()
        for batch in batches:
            made: list[np.ndarray] = []
            names: list[tuple[int, int]] = []
            for _, values in shingle_sets(batch.column(0)):
                name = int(mix(values).sum(dtype=np.uint64)) if len(values) else None
                if name is None or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                for band in bands(len(values)):
                    made.append(shown(values, band, counts))
                    names.append((name, len(made[-1])))
                if len(made) >= 2048:
                    yield _signature_batch(made, names)
                    made, names = [], []
            if made:
                yield _signature_batch(made, names)

    return docs.select("text").mapInArrow(tidy(run), "signature long, name long")


def _signature_batch(made: list[np.ndarray], names: list[tuple[int, int]]) -> pa.RecordBatch:
    ids = np.repeat(np.array([n for n, _ in names], dtype=np.uint64), [k for _, k in names])
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(made))), pa.array(signed(ids))], names=["signature", "name"])


def texts_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(name, text) of the sets whose first document's text has one of ``marks``, once a task or seldom more often; a bitmap stops most others."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(marks))  # 32 MB at most

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            mark = batch.column(0).to_numpy()
            asked = np.flatnonzero(holds(shipped.value, mark))
            fresh = [i for i, m in zip(asked.tolist(), mark[asked].tolist(), strict=True) if m not in seen and not seen.add(m)]
            if len(seen) > SEEN:
                seen.clear()
            texts = batch.column(1).take(pa.array(fresh, pa.int64()))
            names = np.array([int(mix(values).sum(dtype=np.uint64)) for _, values in shingle_sets(texts)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(names)), texts], names=["name", "text"])

    return docs.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(tidy(some), "name long, text string")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of names, those that link, with intersection and union of their exact shingle sets.

    Each b's text travels to its a once. An a with many partners has them dealt to several tasks, and its own text to each; a
    task streams over an a's own row and then its partners, holding one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, y in shingle_sets(batch.column(2)):
                if a[i] == b[i]:
                    lead, x = a[i], y
                elif lead == a[i]:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= PERCENT * (len(x) + len(y) - both):
                        out.append((a[i], b[i], both, len(x) + len(y) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "shared", "united"])

    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("tasks"))
    dealt = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "tasks").cast("int").alias("task"))
    own = tasks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    dealt = dealt.unionByName(own)
    shipped = texts.sparkSession.sparkContext.broadcast(bitmap(dealt.select("b")))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(shipped.value, batch.column(0).to_numpy())))

    rows = texts.select(F.col("name").alias("b"), "text").mapInArrow(tidy(needed), "b long, text string").join(dealt, "b").select("a", "task", (F.col("a") != F.col("b")).alias("other"), "b", "text")
    return rows.repartition("a", "task").sortWithinPartitions("a", "task", "other").select("a", "b", "text").mapInArrow(tidy(run), "a long, b long, shared int, united int").distinct()


def sized(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of names, a < b, whose sizes and parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            some = zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist(), strict=True)
            apart = np.array([least_different(x, y) for x, y in some], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart * (100 + PERCENT) <= n * (100 - PERCENT)))

    side = lambda s: sets.select(F.col("name").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "parity")))
    both = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    named = both.join(side("a"), "a").join(side("b"), "b").where(fits)
    return named.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(tidy(run), "a long, b long")


def degrees(met: DataFrame) -> DataFrame:
    """(signature, name, degree): with each set the sum of its signatures' sizes, which is largest in the middle of a group of near copies."""
    return met.join(met.groupBy("name").agg(F.sum("size").alias("degree")), "name").select("signature", "name", "degree")


def leads(parts: DataFrame) -> DataFrame:
    """(lead, name, k): each set with the leads of its signatures, itself among them, and how many they share; a signature's lead is its set of the largest degree."""
    lead = parts.groupBy("signature").agg(F.max(F.struct("degree", "name")).alias("lead"))
    return parts.join(lead, "signature").groupBy(F.col("lead.name").alias("lead"), "name").agg(F.count("*").alias("k"))


def nearest(led: DataFrame) -> DataFrame:
    """Each set (b) with that lead (a) with which it shares most signatures."""
    return led.where("lead <> name").groupBy(F.col("name").alias("b")).agg(F.max_by("lead", F.struct("k", "lead")).alias("a")).select("a", "b")


def within(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one lead and different components that may link, from (lead, name, component, n, parity).

    A group of more than ``BLOCK`` sets, or ``BLOCK_BYTES`` of parities, is cut into blocks, and each pair of blocks is compared
    in a task of its own.
    """

    def pairs(lo: int, hi: int, slot: np.ndarray, name: np.ndarray, component: np.ndarray, n: np.ndarray, raw: np.ndarray) -> Iterator[np.ndarray]:
        bits, step = Parities(raw), max(1, 65536 // len(n))
        for i in range(0, len(n), step):
            x = slice(i, i + step)
            ok = (component[x, None] != component) & (name[x, None] < name) & (100 * np.minimum(n[x, None], n) >= PERCENT * np.maximum(n[x, None], n))
            if lo != hi:
                ok &= slot[x, None] != slot
            u, w = np.nonzero(ok)
            u += i
            keep = bits.apart(u, w) * (100 + PERCENT) <= (100 - PERCENT) * (n[u] + n[w])
            yield np.stack([name[u[keep]], name[w[keep]]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = np.stack(columns[:3], axis=1)
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            found = [p for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a > 1 for p in pairs(columns[1][a], columns[2][a], *(c[a:b] for c in columns[3:]))]
            found = np.unique(np.concatenate([p for p in found if len(p)] or [np.zeros((0, 2), np.int64)]), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.empty(batch.num_rows, dtype=object)
            raw[:] = batch.column(7).to_pylist()
            own = [*(batch.column(k).to_numpy().astype(np.int64) for k in range(7)), raw]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            if len(last):  # all groups but the last are whole
                yield from done([x[: last[-1] + 1] for x in held])
                held = [x[last[-1] + 1 :] for x in held]
        if held is not None:
            yield from done(held)

    most = F.greatest(F.count("*") / BLOCK, F.sum(F.length("parity").cast("long")) / BLOCK_BYTES)
    size = rows.groupBy("lead").agg(F.ceil(most).cast("int").alias("blocks"))
    dealt = rows.join(size, "lead").withColumn("slot", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("lead", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"), "slot", "name", "component", "n", "parity")
    return cells.repartition("lead", "lo", "hi").sortWithinPartitions("lead", "lo", "hi").mapInArrow(tidy(run), "a long, b long").distinct()


def link(docs: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, links): every row of ``docs`` (doc_id, mark, n, h1), the distinct sets (name, rep, n) and verified links (a, b) between names.

    The links are those that join components, not all: pairs inside a component are skipped once it is known. Their number says
    nothing about the number of similar pairs.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(set_rows(docs))
    first = F.min(F.struct("doc_id", "mark"))
    one = rows.where("sketch is null and n > 0 and doc_id is not null").groupBy(F.col("h1").alias("name"), "n").agg(first.alias("first"), F.first("parity").alias("parity"))
    sets = scratch.keep(one.select("name", "n", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "parity"))
    group = Window.partitionBy("signature")
    both = signature_rows(docs, rarity(rows, BUCKETS)).withColumn("low", F.min("name").over(group)).withColumn("high", F.max("name").over(group)).withColumn("size", F.count("*").over(group))
    met = scratch.keep(both.where("low <> high").select("signature", "name", "size").distinct())
    marks = scratch.keep(sets.join(met.select("name").distinct(), "name", "left_semi").select("mark"))
    texts = scratch.keep(texts_of(docs, marks))  # of sets that share a signature
    led = scratch.keep(leads(degrees(met)))
    scratch.drop(met, marks)
    tried = scratch.keep(sized(nearest(led), sets))
    links = scratch.keep(verified(tried, texts))
    label = components(links, scratch).select(F.col("id").alias("name"), F.col("component").alias("label"))
    parts = scratch.keep(led.join(label, "name", "left").select("lead", "name", F.coalesce("label", "name").alias("component")))
    mixed = parts.groupBy("lead").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("lead")
    open_rows = parts.join(mixed, "lead", "left_semi").join(sets.select("name", "n", "parity"), "name")
    second = scratch.keep(within(open_rows).join(tried, ["a", "b"], "left_anti"))
    links = scratch.keep(links.unionByName(verified(second, texts)))
    scratch.only(rows, sets, links)
    return rows.where("sketch is null").select("doc_id", "mark", "n", "h1"), sets, links


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, representative of equal sets and hash of the text of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows, sets, links = link(docs, scratch)
    label = sets.join(components(links, scratch).withColumnRenamed("id", "name"), "name", "left").select("name", "rep", F.coalesce("component", "name").alias("component"))
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = label.join(least, "component").select(F.col("name").alias("h1"), "rep", "component_id")
    found = rows.join(named, "h1", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("rep", "doc_id").alias("rep"), "mark")
    out = scratch.keep(found)
    scratch.only(out)
    return out


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("mark")
