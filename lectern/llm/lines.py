"""Line de-duplication by an exact set-similarity join.

A line is its set of distinct lower-cased words. Its tokens are ordered by rarity (a count sketch of fixed size over all
documents, ties by hash), and only its prefix is indexed: with Jaccard of at least t, two lines share a token among their first
n - ceil(t n) + 1. Postings meet once, sorted by token and by the lines' place in the corpus. Length, positional and bitmap
filters (parities of a line's tokens, about two bits a token, bound the symmetric difference from below) leave few
candidates. A line goes if an earlier line, by (doc_id, line number), is similar, whether that one stays or not.

In a token's group each line looks back from its nearest predecessor and hands over its best candidate only; it stops at one
that differs in at most half of what is allowed. The best candidate of all its groups is verified on the words of both lines.
Lines that it fails, and that had others, are few; they meet all their candidates in a second round. A group of more than
``GROUP`` rows leaves its task as it is and is compared in pairs of blocks, each in a task of its own.

Words are compared by 64-bit hashes: two of m distinct words collide with odds of m^2 / 2^65. Rows whose doc_id is null or
repeated are named by their place in the order of (doc_id, nulls first; hash of the text; row), so that the first of equal
rows keeps its lines and the others lose theirs as exact repeats.

Defined results: lines are cut at line feeds; a line without words is never removed; null text counts as empty and stays
null; a text whose lines all stay is returned as it is; extra columns are kept, but for ``n_lines`` and ``n_removed_lines``,
which are set anew; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bitmaps import Parities, bitmap, holds
from lectern.llm.sketch import packed, rarity
from lectern.llm.storage import Scratch
from lectern.llm.text import U64, blocks, mix, signed, tidy, words

PERCENT = 75
#: Buckets of the count sketch that orders tokens by rarity: 2 MB of counts, whatever the corpus holds.
SKETCH = 1 << 20
#: ``place`` holds line number << 33 | set size << 17 | position in the set << 1 | (1: a whole-line row), sizes cut at 65535.
#: A whole-line row of size 0 is a repeat within its task, under a token of its own.
MOST_SIZE = (1 << 16) - 1
#: Lines of up to so many tokens have a parity of 64 bits (in ``low``), longer ones of 128, beyond ``NARROW`` tokens a wider one instead.
TINY, NARROW = 32, 64
#: Postings that are compared at a time, and the largest group of a token that one task compares.
CHUNK, GROUP = 1 << 18, 1 << 14
#: Distinct lines that a task remembers, to show equal lines once.
SEEN = 1 << 18
POSTING = "token long, doc_id long, place long, low long, high long, wide binary"
#: A best candidate, or an exact repeat (y_name null), or a posting of a group that is too large (token not null).
FOUND = f"x_doc long, x_line int, y_name long, score int, more boolean, {POSTING}"
LINE = ["x_doc", "x_line"]


def line_offsets(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of lines (a line feed ends its line and is left out by the word splitter), and each row's first line."""
    breaks = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(rows, breaks - 1, side="right") - 1
    starts = np.concatenate([rows[:-1], breaks])
    order = np.argsort(np.concatenate([np.arange(len(rows) - 1) * 2, row * 2 + 1]) * (len(data) + 2) + starts, kind="stable")
    starts = starts[order]
    first = np.zeros(len(rows), dtype=np.int64)
    np.cumsum(np.bincount(row, minlength=len(rows) - 1) + 1, out=first[1:])
    return np.append(starts, len(data)), first


def sketch_bucket(token: np.ndarray) -> np.ndarray:
    return (token >> U64(44)).astype(np.int64)


def token_counts(docs: DataFrame) -> DataFrame:
    """From each task one row with the sketch of its words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                np.add.at(counts, sketch_bucket(words(data, offsets)[0]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed(counts)], pa.binary())], names=["sketch"])

    return docs.select("text").mapInArrow(tidy(run), "sketch binary")


def line_sets(data: np.ndarray, lines: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first; each line's first token."""
    hashes, _, _, at = words(data, lines)
    own = np.repeat(np.arange(len(lines) - 1), np.diff(at))
    order = np.lexsort((hashes, counts[sketch_bucket(hashes)], own))
    hashes, own = hashes[order], own[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    hashes, own = hashes[keep], own[keep]
    cut = np.zeros(len(lines), dtype=np.int64)
    np.cumsum(np.bincount(own, minlength=len(lines) - 1), out=cut[1:])
    return hashes, cut


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + 1


def line_name(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def whole_rows(token: np.ndarray | None, lines: list[tuple[int, int]], size: int) -> pa.RecordBatch:
    """Postings of whole lines; without ``token`` each has a token of its own."""
    doc, number = np.array(lines, dtype=np.int64).T
    token = line_name(doc, number) if token is None else token
    none = pa.array(np.zeros(len(doc), dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(doc), pa.array((number << 33) | (size << 17) | 1), none, none, pa.nulls(len(doc), pa.binary())], names=["token", "doc_id", "place", "low", "high", "wide"])


def parity_words(n: int) -> int:
    """64-bit words of the parity of a line of n tokens."""
    return 1 if n <= TINY else 2 if n <= NARROW else 4 if n <= 128 else 8 if n <= 256 else 16


def parities(tokens: np.ndarray, cut: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Low and high word of each line's narrow parity, and its wide one; a line that has this one travels without the others, which are it folded."""
    place = (tokens >> U64(40)).astype(np.int64) & 1023
    bit = U64(1) << (place & 63).astype(np.uint64)
    upper = (place >> 6 & 1) == 1
    low = np.bitwise_xor.reduceat(np.where(upper, U64(0), bit), cut)
    high = np.bitwise_xor.reduceat(np.where(upper, bit, U64(0)), cut)
    tiny = n <= TINY
    low[tiny] ^= high[tiny]
    high[tiny] = 0
    low[n > NARROW] = high[n > NARROW] = 0
    wide: list[bytes | None] = [None] * len(n)
    for k in np.flatnonzero(n > NARROW).tolist():
        w = parity_words(int(n[k]))
        x = np.zeros(w, dtype=np.uint64)
        own = slice(cut[k], cut[k] + n[k])
        np.bitwise_xor.at(x, place[own] >> 6 & w - 1, bit[own])
        wide[k] = x.tobytes()
    return low, high, wide


def postings(docs: DataFrame, counts: np.ndarray, asked: np.ndarray | None = None) -> DataFrame:
    """From each task a whole-line row for every distinct set (token: its hash; its earliest line) and for every repeat of it (token:
    its own name), and a row for each prefix token of a set's earliest lines so far. With ``asked``, a bitmap of tokens, only the
    prefix rows of those tokens.

    A set to which no other can be similar (one or two words) has no prefix rows. Tokens are shortened to 40 bits, which may
    only bring more candidates.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((counts, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, asked), seen = shipped.value, {}

        def whole() -> Iterator[pa.RecordBatch]:
            names = iter(seen.items())
            while asked is None and (some := list(islice(names, 1 << 16))):
                yield whole_rows(np.array([key for key, _ in some], dtype=np.uint64), [at for _, at in some], 1)
            seen.clear()

        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for first_row, _, data, rows in blocks(batch.column(1)):
                lines, first = line_offsets(data, rows)
                tokens, cut = line_sets(data, lines, counts)
                size = np.diff(cut)
                if not len(tokens):
                    continue
                line = np.flatnonzero(size)
                row = np.searchsorted(first, line, side="right") - 1
                doc, number, n = doc_ids[first_row + row].astype(np.int64), line - first[row], size[line]
                name = mix(np.add.reduceat(mix(tokens), cut[line]) + n.astype(np.uint64))
                fresh, again = np.zeros(len(line), dtype=bool), []
                for i, (key, d, l) in enumerate(zip(name.tolist(), doc.tolist(), number.tolist(), strict=True)):
                    first_so_far = seen.get(key)
                    if first_so_far is None or (d, l) < first_so_far:
                        seen[key] = (d, l)
                        fresh[i] = True
                        if first_so_far is not None:
                            again.append(first_so_far)
                    else:
                        again.append((d, l))
                if again and asked is None:
                    yield whole_rows(None, again, 0)
                keep = np.flatnonzero(fresh & (100 * n >= PERCENT * (n + 1)))
                length = prefix_length(n[keep])
                own = np.repeat(keep, length)
                position = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
                token = tokens[cut[line][own] + position] >> U64(24)
                if asked is not None:
                    some = np.flatnonzero(holds(asked, token))
                    own, position, token = own[some], position[some], token[some]
                if len(own):
                    low, high, wide = parities(tokens, cut[line], n)
                    place = (number << 33 | np.minimum(n, MOST_SIZE) << 17)[own] | np.minimum(position, MOST_SIZE) << 1
                    yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(doc[own]), pa.array(place), pa.array(signed(low[own])), pa.array(signed(high[own])), pa.array(wide, pa.binary()).take(pa.array(own))], names=["token", "doc_id", "place", "low", "high", "wide"])
                if len(seen) > SEEN:
                    yield from whole()
        yield from whole()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), POSTING)


class Group:
    """Sorted postings of some tokens as arrays."""

    def __init__(self, token: np.ndarray, doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, wide: np.ndarray, slot: np.ndarray | None = None) -> None:
        self.token, self.doc, self.place, self.slot = token, doc, place, slot
        self.line = place >> 33
        self.n, self.position, self.whole = (place >> 17 & MOST_SIZE).astype(np.int32), (place >> 1 & MOST_SIZE).astype(np.int32), (place & 1).astype(bool)
        self.rest = np.where(self.whole, -1, self.n - self.position).astype(np.int32)
        self.low, self.high = low.astype(np.int64).view(np.uint64), high.astype(np.int64).view(np.uint64)
        some = np.flatnonzero((self.n > NARROW) & ~self.whole)
        self.wide, self.at = Parities(wide[some]), np.zeros(len(place), dtype=np.int64)
        self.at[some] = np.arange(len(some))
        for size, own in self.wide.own.items():
            self.low[some[self.wide.size == size]] = np.bitwise_xor.reduce(own[:, ::2], axis=1)
            self.high[some[self.wide.size == size]] = np.bitwise_xor.reduce(own[:, 1::2], axis=1)
        self.folded = self.low ^ self.high

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those pairs that pass the length, positional and bitmap filters, and in how many parity bits they differ."""
        nx, ny = self.n[x], self.n[y]
        total = nx + ny
        good = (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & (np.minimum(self.rest[x], self.rest[y]) * (100 + PERCENT) >= PERCENT * total)
        good |= (np.maximum(nx, ny) >= MOST_SIZE) & ~self.whole[x] & ~self.whole[y]
        if self.slot is not None:
            good &= self.slot[x] != self.slot[y]
        x, y, total = x[good], y[good], total[good]
        tiny = np.minimum(self.n[x], self.n[y]) <= TINY
        apart = np.where(tiny, np.bitwise_count(self.folded[x] ^ self.folded[y]), np.bitwise_count(self.low[x] ^ self.low[y]) + np.bitwise_count(self.high[x] ^ self.high[y])).astype(np.int64)
        huge = np.maximum(self.n[x], self.n[y]) >= MOST_SIZE
        good = (apart * (100 + PERCENT) <= (100 - PERCENT) * total) | huge
        x, y, total, apart, huge = x[good], y[good], total[good], apart[good], huge[good]
        both = np.flatnonzero(np.minimum(self.n[x], self.n[y]) > NARROW)
        apart[both] = self.wide.apart(self.at[x[both]], self.at[y[both]])
        good = (apart * (100 + PERCENT) <= (100 - PERCENT) * total) | huge
        return x[good], y[good], apart[good]

    def best(self, begin: int) -> Iterator[pa.RecordBatch]:
        """For rows ``begin`` on, exact repeats and each row's best candidate among the rows before it in its group."""
        m = len(self.token)
        at = np.arange(m)
        same = np.zeros(m, dtype=bool)
        same[1:] = self.token[1:] == self.token[:-1]
        exact = np.flatnonzero(self.whole & ((self.n == 0) | (same & np.roll(self.whole, 1))) & (at >= begin))
        if len(exact):
            yield found(self.doc[exact], self.line[exact])
        start = np.maximum.accumulate(np.where(same, 0, at))
        active = np.flatnonzero((at >= begin) & ~self.whole & (at > start))
        score, other, seen = np.full(m, 1 << 30, dtype=np.int64), np.full(m, -1), np.zeros(m, dtype=np.int8)
        back = 1
        while len(active):
            x, y, apart = self.candidates(active, active - back)
            total = self.n[x] + self.n[y]
            value = 1000 * apart // total
            better = value < score[x]
            score[x[better]], other[x[better]] = value[better], y[better]
            seen[x] = np.minimum(seen[x] + 1, 2)
            # one that differs in half of what is allowed at most lets a line stop; nearer ones may be left
            strong = x[2 * apart * (100 + PERCENT) <= (100 - PERCENT) * total]
            seen[strong] = np.where(strong - back > start[strong], 2, seen[strong])
            start[strong] = m
            back += 1
            active = active[active - back >= start[active]]
        x = np.flatnonzero(other >= 0)
        if len(x):
            y = other[x]
            yield found(self.doc[x], self.line[x], line_name(self.doc[y], self.line[y]), score[x], seen[x] > 1)

    def all_of(self, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All candidates of the lines whose names are in a bitmap."""
        at = np.arange(len(self.token))
        same = np.zeros(len(at), dtype=bool)
        same[1:] = self.token[1:] == self.token[:-1]
        start = np.maximum.accumulate(np.where(same, 0, at))
        active = np.flatnonzero(holds(asked, line_name(self.doc, self.line)) & (at > start))
        back = 1
        while len(active):
            x, y, apart = self.candidates(active, active - back)
            if len(x):
                yield found(self.doc[x], self.line[x], line_name(self.doc[y], self.line[y]), apart, np.zeros(len(x), dtype=bool))
            back += 1
            active = active[active - back >= start[active]]


def found(doc: np.ndarray, line: np.ndarray, y: np.ndarray | None = None, score: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    rest = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())] if y is None else [pa.array(signed(y)), pa.array(score.astype(np.int32)), pa.array(more)]
    none = [pa.nulls(n, pa.int64())] * 5 + [pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line.astype(np.int32)), *rest, *none], names=[x.split()[0] for x in FOUND.split(", ")])


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    wide = np.empty(batch.num_rows, dtype=object)
    wide[:] = batch.column(5).to_pylist()
    return [*(batch.column(k).to_numpy() for k in range(5)), wide, *(batch.column(k).to_numpy() for k in range(6, batch.num_columns))]


def meet(rows: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """``FOUND`` rows of postings: best candidates and exact repeats, or with ``asked`` all candidates of the lines it names.

    Memory holds ``CHUNK`` rows and a group of at most ``GROUP``; larger groups are handed on.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(asked)
    chunk, group = CHUNK, GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        passed_on: int | None = None

        def handed_on(part: list[np.ndarray]) -> pa.RecordBatch:
            n = len(part[0])
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())]
            return pa.RecordBatch.from_arrays([*none, *(pa.array(c) for c in part[:5]), pa.array(part[5].tolist(), pa.binary())], names=[x.split()[0] for x in FOUND.split(", ")])

        def compared(last: bool) -> Iterator[pa.RecordBatch]:
            """All whole groups of what is held; the rest stays."""
            nonlocal passed_on
            all_rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            token = all_rows[0]
            cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            whole = (all_rows[2][cut[:-1]] & 1) == 1  # of exact repeats, which are never too many: a row looks at the one before
            large = ((np.diff(cut) > group) | (token[cut[:-1]] == passed_on)) & ~whole if passed_on is not None else (np.diff(cut) > group) & ~whole
            for k in np.flatnonzero(large).tolist():
                yield handed_on([c[cut[k] : cut[k + 1]] for c in all_rows])
            open_one = not last and len(cut) > 1
            keep = np.repeat(~large, np.diff(cut))
            if open_one:
                keep[cut[-2] :] = False
            passed_on = int(token[-1]) if large[-1] else None
            done = [c[keep] for c in all_rows]
            if len(done[0]):
                parts = Group(*done)
                yield from parts.best(0) if shipped.value is None else parts.all_of(shipped.value)
            if open_one and not large[-1]:
                # of a group of whole lines its first row is enough to tell the others
                rest = [c[cut[-2] :] for c in all_rows]
                if whole[-1] and len(rest[0]) > 1:
                    yield from Group(*rest).best(0) if shipped.value is None else ()
                    rest = [c[:1] for c in rest]
                held.append([c.copy() for c in rest])

        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(_arrays(batch))
                waiting += batch.num_rows
            if waiting >= chunk:
                yield from compared(False)
                waiting = 0
        if held:
            yield from compared(True)

    return rows.repartition("token").sortWithinPartitions("token", "doc_id", "place").mapInArrow(tidy(run), FOUND)


def meet_in_blocks(rows: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """As ``meet``, for groups of any size: each pair of blocks of a group is a task's group of its own."""
    shipped = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def compared() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            group = Group(*columns[:6], slot=None if columns[7][0] == columns[8][0] else columns[6])
            yield from group.best(0) if shipped.value is None else group.all_of(shipped.value)

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _arrays(batch)
            cells = np.stack([own[0], own[7], own[8]], axis=1)
            cut = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(axis=1), [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and tuple(cells[a]) != key:
                    yield from compared()
                key = tuple(cells[a])
                held.append([c[a:b] for c in own])
        if held:
            yield from compared()

    size = rows.groupBy("token").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = rows.join(size, "token").withColumn("slot", F.pmod(F.xxhash64("doc_id", "place"), "blocks").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(*(x.split()[0] for x in POSTING.split(", ")), "slot", F.least("slot", "other").alias("lo"), F.greatest("slot", "other").alias("hi"))
    return cells.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "doc_id", "place").mapInArrow(tidy(run), FOUND)


def met(rows: DataFrame, scratch: Scratch, asked: np.ndarray | None = None) -> DataFrame:
    """All ``FOUND`` rows but the postings that were handed on."""
    first = scratch.keep(meet(rows, asked))
    large = first.where("token is not null").select(*(x.split()[0] for x in POSTING.split(", ")))
    out = first.where("token is null").select(*LINE, "y_name", "score", "more")
    if large.limit(1).count():
        out = out.unionByName(scratch.keep(meet_in_blocks(large, asked)).select(*LINE, "y_name", "score", "more"))
    return out


def texts_of_lines(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, line's bytes) of the lines that a bitmap of ``names`` lets pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for first_row, _, data, rows in blocks(batch.column(1)):
                lines, first = line_offsets(data, rows)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(first))
                name = line_name(doc_ids[first_row + row], np.arange(len(row)) - first[row])
                some = np.flatnonzero(holds(shipped.value, name))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(name[some])), pa.array([data[lines[k] : lines[k + 1]].tobytes() for k in some.tolist()], pa.binary())], names=["name", "line"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "name long, line binary")


def shared_counts(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words that each row's two lines share, and that they have together."""
    sides = []
    for column in (x, y):
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in column.to_pylist()])])
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        hashes, _, _, at = words(data, offsets)
        row = np.repeat(np.arange(len(column)), np.diff(at))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        keep = np.ones(len(row), dtype=bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        sides.append((hashes[keep], row[keep]))
    hashes, row = (np.concatenate([a, b]) for a, b in zip(*sides, strict=True))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    twice = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shared = np.bincount(row[1:][twice], minlength=len(x))
    return shared, np.bincount(row, minlength=len(x)) - shared


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x_doc, x_line) of the pairs (x_doc, x_line, x_name, y_name) whose lines are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shared, union = shared_counts(batch.column(2), batch.column(3))
                yield batch.select(LINE).filter(pa.array(100 * shared >= PERCENT * union))

    side = lambda s: texts.select(F.col("name").alias(f"{s}_name"), F.col("line").alias(s))
    both = pairs.select(*LINE, "x_name", "y_name").join(side("x"), "x_name").join(side("y"), "y_name")
    return both.select(*LINE, "x", "y").mapInArrow(tidy(run), "x_doc long, x_line int").distinct()


def with_name(rows: DataFrame) -> DataFrame:
    """``rows`` of (x_doc, x_line, ...) with the line's hash as ``x_name``."""

    @F.arrow_udf("long")
    def name(doc: pa.Array, line: pa.Array) -> pa.Array:
        return pa.array(signed(line_name(doc.to_numpy(), line.to_numpy())))

    return rows.withColumn("x_name", name("x_doc", "x_line"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line) of every line that goes; doc_ids must not be null or repeated (see ``named``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    counts = rarity(token_counts(docs), SKETCH)
    all_found = met(postings(docs, counts), scratch)
    exact = all_found.where("y_name is null").select(*LINE)
    best = all_found.where("y_name is not null").groupBy(*LINE).agg(F.min(F.struct("score", "y_name")).alias("best"), (F.max("more") | (F.min("y_name") != F.max("y_name"))).alias("more"))
    pairs = scratch.keep(with_name(best.join(exact, LINE, "left_anti").select(*LINE, "best.y_name", "more")))
    ends = pairs.select(F.col("x_name").alias("name")).unionByName(pairs.select(F.col("y_name").alias("name")))
    texts = scratch.keep(texts_of_lines(docs, ends))
    near = scratch.keep(similar(pairs, texts))
    gone = exact.unionByName(near)
    left = scratch.keep(pairs.where("more").join(near, LINE, "left_anti"))
    if left.limit(1).count():
        gone = gone.unionByName(second_round(docs, counts, left, texts, scratch))
    out = scratch.keep(gone.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line")).distinct())
    scratch.only(out)
    return out


def second_round(docs: DataFrame, counts: np.ndarray, left: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines of ``left`` (x_doc, x_line, x_name, y_name: tried) that are similar to another earlier line."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(0).to_pylist()
                tokens, cut = line_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), shipped.value)
                n = np.diff(cut)
                early = np.arange(len(tokens)) - np.repeat(cut[:-1], n) < np.repeat(prefix_length(n), n)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(tokens[early] >> U64(24))))], names=["token"])

    own = texts.join(left.select(F.col("x_name").alias("name")).distinct(), "name", "left_semi").select("line")
    tokens = bitmap(scratch.keep(own.mapInArrow(tidy(prefixes), "token long").distinct()))
    names = bitmap(left.select("x_name"))
    every = met(postings(docs, counts, tokens), scratch, names).select(*LINE, "y_name").distinct()
    pairs = scratch.keep(every.join(left.select(*LINE, "x_name"), LINE).join(left.select(*LINE, "y_name"), [*LINE, "y_name"], "left_anti"))
    ends = pairs.select(F.col("x_name").alias("name")).unionByName(pairs.select(F.col("y_name").alias("name")))
    return scratch.keep(similar(pairs, texts_of_lines(docs, ends)))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def named(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` and the column that names its rows in order: doc_id, or a place of their own where a doc_id is null or repeated.

    Places are dealt by range over (doc_id, hash, row), so that no doc_id or text, however often it is repeated, fills one task.
    """
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return docs, "doc_id"
    row, place = unused(docs, "_row"), unused(docs, "_place")
    docs = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col(row)]
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), row)
    # partition number << 33 | number in the partition, of rows sorted over all partitions
    places = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(row, F.monotonically_increasing_id().alias(place)))
    out = scratch.keep(docs.join(places, row).drop(row))
    scratch.only(out)
    return out, place


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and ``n_lines``, ``n_removed_lines``."""

    @F.arrow_udf("string")
    def left_of(text: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for value, lines in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            if value is None or not lines:
                out.append(value)
            else:
                less = set(lines)
                out.append("\n".join(x for i, x in enumerate(value.split("\n")) if i not in less))
        return pa.array(out, pa.string())

    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    docs, name = named(docs.select(*columns), Scratch(docs.sparkSession))
    gone = removed_lines(docs.select(F.col(name).alias("doc_id"), "text"))
    own = unused(docs, "_gone")
    gone = gone.groupBy(F.col("doc_id").alias(name)).agg(F.collect_list("line").alias(own))  # at most a document's lines
    both = docs.join(gone, name, "left")
    count = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1, F.lit(1)).cast("long")
    once = left_of.asNondeterministic()  # else a filter on the text has it run again below, in a worker of its own
    kept_columns = [once("text", own).alias("text") if c == "text" else F.col(c) for c in columns]
    return both.select(*kept_columns, count.alias("n_lines"), F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_removed_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.greatest("n_lines", F.lit(1)).alias("n_lines"), "n_removed_lines", F.length(body).cast("long").alias("n_kept_chars"), F.sha2(body, 256).alias("kept_sha256"))


__all__ = ["dedup_lines", "op6_line_dedup", "removed_lines"]
