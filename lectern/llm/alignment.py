"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and corpus-wide counts of linked ids.

Tokens of both sides are the nodes of a bipartite graph, an edge joins two tokens that share a byte. Union-find over the edges
gives the connected components, which are the minimal groups: two cuts of the same bytes have no common boundary inside a
component and one at its end. All tokens of one side of a component are linked with all of the other. Each document gives its
distinct linked id pairs with their number of links; pairs are counted by documents in one shuffle and the counts joined back.

Defined results: null or empty text, and text that one of the tokenizers changes, has no tokens: zeros and an empty digest. Rows
with one doc_id, or none, and equal rows are documents of their own. An empty table gives an empty table. Columns other than
doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.storage import Scratch
from lectern.llm.text import BLOCK_BYTES, IS_SPACE, blocks, tidy

#: Pre-tokens that may be longer than this many bytes go to the encoder whose time grows with their length, not its square.
LONG_RUN = 4000
#: Links of a group are made one by one up to this number, beyond it by distinct ids and how often they occur.
DENSE = 1024
#: Counted pairs up to which their table (24 bytes a pair) is broadcast; a larger one is shuffled, with the same rows.
BROADCAST_PAIRS = 1 << 21
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def byte_level_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Bytes and ids of a byte-level vocabulary in JSON, special tokens left out: printable characters are bytes, others lie from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    content = json.loads(vocabulary)
    special = {x["content"] for x in content["added_tokens"]}
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in content["model"]["vocab"].items() if token not in special}


class Sides:
    """Both tokenizers of a worker, and what their ids stand for."""

    def __init__(self, vocabulary: bytes, pattern: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken

        ranks = byte_level_ranks(vocabulary)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.content = pattern, b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id's text with what follows it in the listing: another id of its side, the end of its side
        self.a_text, self.b_text = (np.array([[f"{i}{mark}" for i in range(len(x))] for mark in marks], dtype=object) for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

    def encode_a(self, texts: list[str], raws: list[bytes]) -> list[list[int]]:
        """Ids of space and text; both encoders give the same."""
        out = []
        for text, raw in zip(texts, raws, strict=True):
            if len(raw) > LONG_RUN and longest_run(raw) > LONG_RUN:
                out.append(bpe.codec(self.content, self.pattern).encode(" " + text))
            else:
                out.append(self.a.encode_ordinary(" " + text))
        return out


def longest_run(raw: bytes) -> int:
    """Length of the longest run of white space or of other bytes; no pre-token is longer by more than its space."""
    space = IS_SPACE[np.frombuffer(raw, np.uint8)]
    return int(np.diff(np.flatnonzero(np.diff(space)), prepend=-1, append=len(raw) - 1).max())


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component: union-find over the edges a[i] - b[i] of nodes 0 .. n - 1, all edges at a time."""
    parent = np.arange(n)
    while len(a):
        left, right = parent[a], parent[b]
        open_edges = left != right
        a, b, left, right = a[open_edges], b[open_edges], left[open_edges], right[open_edges]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def align(sides: Sides, raws: list[bytes], texts: list[str]) -> pa.RecordBatch:
    """The columns of ``ALIGNED`` but doc_id for a block of texts; ``raws`` are their UTF-8 bytes."""
    n = len(texts)
    ids_a, ids_b = sides.encode_a(texts, raws), sides.b.encode(texts, num_threads=1)
    for k, raw in enumerate(raws):
        whole = b" " + raw
        if not raw or b"".join(map(sides.a_bytes.__getitem__, ids_a[k])) != whole or b"".join(map(sides.b_bytes.__getitem__, ids_b[k])) != whole:
            ids_a[k], ids_b[k] = [], []
    n_a, n_b = (np.array(list(map(len, ids)), dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.array([i for row in ids for i in row], dtype=np.int64) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b])
    # an edge for each stretch of bytes between neighbouring boundaries: the tokens of both sides that hold it
    stretch = np.union1d(end_a, end_b)
    on_a, on_b = np.searchsorted(end_a, stretch), np.searchsorted(end_b, stretch)
    root = components(on_a, len(a) + on_b, len(a) + len(b))
    groups, of = np.unique(root, return_inverse=True)  # each holds tokens of both sides; ordered by its first token of A
    of_a, of_b = of[: len(a)], of[len(a) :]
    many_a, many_b = np.bincount(of_a, minlength=len(groups)), np.bincount(of_b, minlength=len(groups))
    row_of_a = np.repeat(np.arange(n), n_a)
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    row = row_of_a[first_a]
    n_groups, n_links = np.bincount(row, minlength=n), np.bincount(row, weights=many_a * many_b, minlength=n).astype(np.int64)
    # listing: A's ids of a group, then B's
    listing = np.empty(len(a) + len(b), dtype=object)
    last_a, last_b = (np.diff(x, append=-1) != 0 for x in (of_a, of_b))
    listing[np.arange(len(a)) + first_b[of_a]] = sides.a_text[last_a.astype(np.int64), a]
    listing[np.arange(len(b)) + (first_a + many_a)[of_b]] = sides.b_text[last_b.astype(np.int64), b]
    at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    digest = ["" if s == e else hashlib.sha256("".join(listing[s:e].tolist())[:-1].encode()).hexdigest() for s, e in zip(at, at[1:], strict=False)]
    # links: one by one in small groups, by distinct ids in large ones
    large = many_a * many_b > DENSE
    mine = np.flatnonzero(~large[of_a])
    times = many_b[of_a[mine]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key = [np.repeat(a[mine], times) << 32 | b[np.repeat(first_b[of_a[mine]], times) + step]]
    key_row, weight = [np.repeat(row_of_a[mine], times)], [np.ones(len(step), dtype=np.int64)]
    for g in np.flatnonzero(large).tolist():
        kinds_a, times_a = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
        kinds_b, times_b = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
        key.append((kinds_a[:, None] << 32 | kinds_b[None, :]).reshape(-1))
        weight.append((times_a[:, None] * times_b[None, :]).reshape(-1))
        key_row.append(np.full(len(key[-1]), row[g]))
    keys, rows, weights = np.concatenate(key), np.concatenate(key_row), np.concatenate(weight)
    order = np.lexsort((keys, rows))
    keys, rows, weights = keys[order], rows[order], weights[order]
    fresh = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(rows, prepend=-1) != 0))
    sums = np.add.reduceat(weights, fresh) if len(fresh) else weights
    offsets = pa.array(np.searchsorted(rows[fresh], np.arange(n + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)), pa.array(digest, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(keys[fresh])), pa.ListArray.from_arrays(offsets, pa.array(sums))],
        names=[x.split()[0] for x in ALIGNED.split(", ")][1:],
    )


def aligned(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """Per document its groups, links and distinct linked id pairs (a << 32 | b) with their links, as ``ALIGNED``."""
    shipped = docs.sparkSession.sparkContext.broadcast((bpe.read_vocabulary(vocabulary), pattern, bpe.read_vocabulary(model)))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*shipped.value)
        for batch in batches:
            for first, end, data, rows in blocks(batch.column(1), BLOCK_BYTES // 2):
                raws = [data[s:e].tobytes() for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                out = align(sides, raws, [x.decode() for x in raws])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *out.columns], names=["doc_id", *out.schema.names])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its A id is held by more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", 32))  # at most B's vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def cross_tokenizer(docs: DataFrame, vocabulary: str, pattern: str, model: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links of corpus-wide best pairs, sum of the links' counts, digest of the groups."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(aligned(docs, vocabulary, pattern, model).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.keep(pair_counts(found))
    small = counts.count() <= broadcast_pairs
    links = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = links.join(F.broadcast(counts) if small else counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    whole = found.drop("pairs", "links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cross_tokenizer(docs, public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
