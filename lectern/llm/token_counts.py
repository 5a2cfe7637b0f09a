"""Edit-aware token counts.

A document is kept as a tree over its pre-tokens: a leaf holds a run of pre-tokens, an inner node the sums of characters and
tokens below it. An edit descends to the pre-tokens it touches, re-splits from a boundary that the edit cannot reach
(``CONTEXT`` characters before it) until the new boundaries meet the old ones again, re-encodes only those pre-tokens, and
updates the sums on the way up.

Defined results: null text counts as empty; edit positions are clipped to the text as it is when the edit applies; null
edits are none; a null replacement is empty; edits of a document apply in the order given, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import ByteBpe, codec, read_vocabulary

#: Characters past its end that can decide where a pre-token ends: contractions look up to 3 ahead.
CONTEXT = 3
LEAF = 64
#: Characters of text that are split ahead.
GROUP_CHARS = 4 << 20
SCHEMA = "doc_id long, n_edits int, n_tokens_before long, n_tokens_after long, n_chars_after long, n_reencoded long, n_pretokens long, edited_sha256 string"


class CountTree:
    """Pre-tokens of one document with sums of characters and tokens."""

    def __init__(self, text: str, bpe: ByteBpe, pieces: list[str] | None = None) -> None:
        self.bpe = bpe
        self.encoded = 0
        self._build(self._pieces(bpe.split(text) if pieces is None else pieces))

    def _pieces(self, pieces: list[str]) -> list[tuple[str, int]]:
        self.encoded += len(pieces)
        ids = self.bpe.piece_ids
        return [(p, ids(p).count(" ") + 1) for p in pieces]

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        width = 1
        while width < len(self.leaves):
            width *= 2
        self.width = width
        self.chars, self.tokens = [0] * (2 * width), [0] * (2 * width)
        for i, leaf in enumerate(self.leaves):
            self.chars[width + i] = sum(len(p) for p, _ in leaf)
            self.tokens[width + i] = sum(t for _, t in leaf)
        for node in range(width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)

    def _update(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node] = sum(len(p) for p, _ in self.leaves[leaf])
        self.tokens[node] = sum(t for _, t in self.leaves[leaf])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf and index of the pre-token that holds character ``at``, and where that pre-token starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf = node - self.width
        for index, (piece, _) in enumerate(self.leaves[leaf]):
            if at < start + len(piece):
                return leaf, index, start
            start += len(piece)
        return leaf, len(self.leaves[leaf]), start

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end (clipped) by ``new``."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        leaf, index, begin = self._find(max(0, start - CONTEXT))
        prefix = self._slice(leaf, index, begin, start)
        last_leaf, last_index, at = self._find(end)
        if last_index < len(self.leaves[last_leaf]) and at < end:
            at += len(self.leaves[last_leaf][last_index][0])
            tail, last_index = self._slice(last_leaf, last_index, at - len(self.leaves[last_leaf][last_index][0]), at)[end - at :], last_index + 1
        else:
            tail = ""
        # old boundaries after the edit, taken one at a time until a new boundary meets one
        fresh, more = prefix + new + tail, self._following(last_leaf, last_index)
        settled, done = [], False
        while not done:
            look, ahead = fresh, []
            for piece in more:
                ahead.append(piece)
                look += piece[0]
                if len(look) - len(fresh) >= 64:
                    break
            ended = len(look) == len(fresh) or not ahead
            pieces = self.bpe.split(look)
            bounds, where = {len(fresh): 0}, len(fresh)
            for k, (piece, _) in enumerate(ahead):
                where += len(piece)
                bounds[where] = k + 1
            done_at, upto = None, 0
            for k, piece in enumerate(pieces):
                if upto >= len(fresh) and upto in bounds and (ended or len(look) - upto > CONTEXT):
                    done_at = k
                    break
                upto += len(piece)
            if done_at is None and ended:
                done_at = len(pieces)
            if done_at is None:
                fresh, consumed = look, len(ahead)
            else:
                settled, consumed, done = pieces[:done_at], bounds.get(upto, len(ahead)), True
            for _ in range(consumed):
                if last_index >= len(self.leaves[last_leaf]):
                    last_leaf, last_index = last_leaf + 1, 0
                    while last_leaf < len(self.leaves) and not self.leaves[last_leaf]:
                        last_leaf += 1
                last_index += 1
            more = self._following(last_leaf, last_index)
        self._splice(leaf, index, last_leaf, last_index, self._pieces(settled))

    def _following(self, leaf: int, index: int) -> Iterator[tuple[str, int]]:
        while leaf < len(self.leaves):
            yield from self.leaves[leaf][index:]
            leaf, index = leaf + 1, 0

    def _slice(self, leaf: int, index: int, begin: int, upto: int) -> str:
        out = []
        for piece, _ in self._following(leaf, index):
            if begin >= upto:
                break
            out.append(piece[: upto - begin])
            begin += len(piece)
        return "".join(out)

    def _splice(self, leaf: int, index: int, last_leaf: int, last_index: int, pieces: list[tuple[str, int]]) -> None:
        if last_leaf >= len(self.leaves):
            last_leaf, last_index = len(self.leaves) - 1, len(self.leaves[-1])
        rest = self.leaves[last_leaf][last_index:]
        if leaf == last_leaf:
            self.leaves[leaf] = self.leaves[leaf][:index] + pieces + rest
            touched = [leaf]
        else:
            self.leaves[leaf] = self.leaves[leaf][:index] + pieces
            for k in range(leaf + 1, last_leaf):
                self.leaves[k] = []
            self.leaves[last_leaf] = rest
            touched = range(leaf, last_leaf + 1)
        if len(self.leaves[leaf]) > 8 * LEAF:
            self._build([p for run in self.leaves for p in run])
        else:
            for k in touched:
                self._update(k)


def recount(docs: DataFrame, vocabulary: str, pattern: str, edits: str = "edits") -> DataFrame:
    """Token counts of each document before and after its edits.

    ``edits`` names an array<struct<start int, end int, text string>> column; positions count characters.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shipped.value, pattern)
        for batch in batches:
            rows, texts, split = [], [text or "" for text in batch.column(1).to_pylist()], {}
            for k, (doc_id, text, changes) in enumerate(zip(batch.column(0), texts, batch.column(2), strict=True)):
                if k not in split:  # split the next texts and merge their new pre-tokens together
                    split, held = {}, 0
                    for ahead in range(k, len(texts)):
                        if split and held + len(texts[ahead]) > GROUP_CHARS:
                            break
                        split[ahead] = bpe.split(texts[ahead])
                        held += len(texts[ahead])
                    bpe.learn(set().union(*split.values()))
                tree = CountTree(text, bpe, split.pop(k))
                before, first = tree.n_tokens, tree.encoded
                changes = [c for c in changes.as_py() or [] if c is not None]
                for c in changes:
                    start = c["start"] or 0
                    tree.replace(start, start if c["end"] is None else c["end"], c["text"] or "")
                rows.append((doc_id.as_py(), len(changes), before, tree.n_tokens, tree.n_chars, tree.encoded - first, sum(map(len, tree.leaves)), hashlib.sha256(tree.text().encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))))

    return docs.select("doc_id", "text", edits).mapInArrow(run, SCHEMA)


def review_edits(text: Column, doc_id: Column) -> Column:
    """Three edits that a review pass would make of any document: a word replaced, a note inserted, a stretch removed."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), F.greatest(n, F.lit(1))).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + size).cast("int").alias("end"), F.lit(new).alias("text"))
    return F.array(edit(at(1), 7, "they're revised"), edit(at(2), 0, " [note 12]\n"), edit(at(3), 40, ""))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", review_edits(F.col("text"), F.col("doc_id")).alias("edits"))
    return recount(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
