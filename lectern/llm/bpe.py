"""Byte-level BPE encoding and decoding.

Pre-tokens are merged through a hierarchical-bitmap rank queue: a bucket per merge rank holds linked-list positions, a
two-level bitmap with find-first-set yields the lowest rank that still has a position, and entries whose pair has changed
since are skipped when they surface. A pre-token of n bytes costs O(n log n), also where it is megabytes long. Short
pre-tokens share one queue: a bucket then holds positions of many pre-tokens, and each pop merges the leftmost one of every
pre-token at once.

Defined results: null text encodes as empty text; empty text has no ids; special-token strings are ordinary text; repeated
rows are encoded alike; an empty table gives an empty table; extra input columns are left alone.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.text import blocks, tidy

#: Pre-tokens and words up to this many characters are remembered; longer ones are merged each time.
CACHE_CHARS = 24
#: A worker's remembered pre-tokens and words take about this many bytes, as estimated by ``entry_bytes``, and those of one more
#: group at most; then it forgets them.
CACHE_BYTES = 48 << 20
#: Characters of text whose new pre-tokens share a queue; their words are in memory together.
SHARED_CHARS = 4 << 20
#: Fixed value: the pattern for which text may be cut before single spaces, each part being split alone.
SPACE_CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK_RUN = regex.compile(r"\s \s|  |\s $|^ \s")
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def entry_bytes(key: str, value: str) -> int:
    """About what a dictionary entry of two short strings takes: their objects, and the table's share."""
    return len(key) + len(value) + 150


class RankQueue:
    """Buckets by merge rank under a two-level bitmap of the ranks that have one."""

    def __init__(self) -> None:
        self.top = 0
        self.leaf: dict[int, int] = {}
        self.bucket: dict[int, list] = {}

    def opened(self, rank: int) -> list:
        """The bucket of a rank, made if there is none."""
        held = self.bucket.get(rank)
        if held is None:
            held = self.bucket[rank] = []
            word = rank >> 8
            self.leaf[word] = self.leaf.get(word, 0) | 1 << (rank & 255)
            self.top |= 1 << word
        return held

    def lowest(self) -> int:
        word = (self.top & -self.top).bit_length() - 1
        bits = self.leaf[word]
        return (word << 8) + (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> list:
        """Take a rank's bucket out."""
        word = rank >> 8
        self.leaf[word] ^= 1 << (rank & 255)
        if not self.leaf[word]:
            del self.leaf[word]
            self.top ^= 1 << word
        return self.bucket.pop(rank)

    def push(self, rank: int, position: int) -> None:
        heappush(self.opened(rank), position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        rank = self.lowest()
        held = self.bucket[rank]
        position = heappop(held)
        if not held:
            self.close(rank)
        return rank, position


class Spaced(dict):
    """Ids of words by the word with its space; what isn't remembered is made anew."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        return " ".join(map(self.bpe.piece_ids, self.bpe.split(word)))


class ByteBpe:
    """Encoder and decoder over one vocabulary; what it remembers is bounded in bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern, regex.V0).findall
        self.cache: dict[str, str] = {}
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.spaced: Spaced | None = Spaced(self) if pattern == SPACE_CUT_PATTERN else None
        self.held = 0
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        pair: list[int | None] = [None] * (n + 1)
        queue = RankQueue()
        push, pop = queue.push, queue.pop
        for i in range(n - 1):
            rank = pair[i] = rank_of(piece[i : i + 2])
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale: the pair at i has changed or gone
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            pair[j] = pair[i] = None
            if k < n:
                new = pair[i] = rank_of(piece[i : after[k]])
                if new is not None:
                    push(new, i)
            h = before[i]
            if h >= 0:
                new = pair[h] = rank_of(piece[h:k])
                if new is not None:
                    push(new, h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, -1 where they don't merge; negative ids never do."""
        if self.pairs is None:
            found = {(a << 32) | b: rank for token, rank in self.ranks.items() for cut in range(1, len(token)) if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None}
            keys = np.fromiter(found.keys(), np.int64, len(found))
            order = np.argsort(keys)
            self.pairs = keys[order], np.fromiter(found.values(), np.int64, len(found))[order]
        keys, ranks = self.pairs
        want = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((keys[at] == want) & (left >= 0) & (right >= 0), ranks[at], -1)

    def merge_shared(self, pieces: list[bytes]) -> list[str]:
        """Joined ids of short pre-tokens, all merged through one queue."""
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        joined: list[str] = []
        if todo:
            byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
            raw = np.frombuffer(b"\0".join(todo) + b"\0", dtype=np.uint8)
            sizes = np.fromiter(map(len, todo), np.int64, len(todo))
            stops = np.cumsum(sizes + 1) - 1
            owner = np.repeat(np.arange(len(todo), dtype=np.int32), sizes + 1)
            ids = byte_ids[raw]
            ids[stops] = -1
            after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
            pair = np.full(len(ids), -1, dtype=np.int32)
            pair[:-1] = self.pair_ranks(ids[:-1], ids[1:])
            queue = RankQueue()

            def push(ranks: np.ndarray, at: np.ndarray) -> None:
                keep = ranks >= 0
                ranks, at = ranks[keep], at[keep]
                order = np.argsort(ranks, kind="stable")
                ranks, at = ranks[order], at[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for rank, a, b in zip(ranks[[0, *cuts]].tolist() if len(ranks) else [], [0, *cuts], [*cuts, len(ranks)], strict=False):
                    queue.opened(rank).append(at[a:b])

            push(pair, np.arange(len(ids), dtype=np.int32))
            while queue.top:
                rank = queue.lowest()
                held = queue.close(rank)
                at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
                at = at[pair[at] == rank]  # the rest is stale
                if not len(at):
                    continue
                own = owner[at]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                if len(again):
                    queue.opened(rank).append(at[again])
                    at = np.delete(at, again)
                gone = after[at]
                beyond = after[gone]
                ids[at], ids[gone], pair[gone] = rank, -2, -1
                after[at] = beyond
                before[beyond] = at
                ahead = before[at]
                known = ahead >= 0
                new = self.pair_ranks(ids[at], ids[beyond])
                pair[at] = new
                ahead, behind = ahead[known], at[known]
                old = self.pair_ranks(ids[ahead], ids[behind])
                pair[ahead] = old
                push(np.concatenate([new, old]), np.concatenate([at, ahead]))
            live = ids != -2
            names = list(map(str, ids[live].tolist()))
            ends = np.flatnonzero(ids[live] == -1).tolist()
            begin = 0
            for end in ends:
                joined.append(" ".join(names[begin:end]))
                begin = end + 1
        rest = iter(joined)
        return [next(rest) if w is None else str(w) for w in whole]

    def room(self) -> None:
        """Forget everything once it takes more than its share; only between groups, which use what they have just learnt."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            if self.spaced is not None:
                self.spaced.clear()
            self.held = 0

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pre-tokens that are short and new."""
        new = [p for p in pieces if p not in self.cache and len(p) <= CACHE_CHARS]
        ids = self.merge_shared([p.encode() for p in new])
        self.cache.update(zip(new, ids, strict=True))
        self.held += sum(map(entry_bytes, new, ids))

    def piece_ids(self, piece: str) -> str:
        """Decimal ids of one pre-token, joined by spaces."""
        found = self.cache.get(piece)
        if found is None:
            found = " ".join(map(str, self.merge(piece.encode())))
            if len(piece) <= CACHE_CHARS and self.held <= CACHE_BYTES:
                self.cache[piece] = found
                self.held += entry_bytes(piece, found)
        return found

    def encode_joined(self, text: str) -> str:
        """Decimal ids of a text, joined by spaces; empty for empty text."""
        return " ".join(map(self.piece_ids, self.split(text)))

    def encode_many(self, texts: list[str]) -> Iterator[str]:
        """``encode_joined`` of each text; new pre-tokens of up to ``SHARED_CHARS`` characters are merged together."""
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= SHARED_CHARS):
                held += len(texts[end])
                end += 1
            yield from self._encode_group(texts[begin:end])
            begin = end

    def encode_column(self, column: pa.Array) -> Iterator[str]:
        """``encode_many`` of an Arrow array (null: empty text), of which a few rows are Python strings at a time."""
        for first, end, _, _ in blocks(column, SHARED_CHARS):
            yield from self._encode_group([x or "" for x in column.slice(first, end - first).to_pylist()])

    def _encode_group(self, texts: list[str]) -> Iterator[str]:
        self.room()
        if self.spaced is None:
            split = [self.split(t) for t in texts]
            self.learn(set().union(*split))
            for pieces in split:
                yield " ".join(map(self.piece_ids, pieces))
            return
        # Between a character that isn't white space and a single space, the pattern always has a boundary, and what
        # stands before it has no part in what follows; texts with runs of white space are split as a whole.
        cut = [None if BLANK_RUN.search(t) else t.split(" ") for t in texts]
        first = {parts[0] for parts in cut if parts}
        new = {" " + w for w in set().union(*(parts[1:] for parts in cut if parts))} | {w for w in first if w}
        new = [w for w in new if w not in self.spaced and len(w) <= CACHE_CHARS]
        pieces_of = [self.split(w) for w in new]
        whole = [self.split(t) if parts is None else None for t, parts in zip(texts, cut, strict=True)]
        self.learn(set().union(*pieces_of, *(w for w in whole if w)))
        ids = self.piece_ids
        joined = [" ".join(map(ids, pieces)) for pieces in pieces_of]
        self.spaced.update(zip(new, joined, strict=True))
        self.held += sum(map(entry_bytes, new, joined))
        del new, pieces_of, joined
        found = self.spaced.__getitem__
        for parts, pieces in zip(cut, whole, strict=True):
            if parts is None:
                yield " ".join(map(ids, pieces))
            else:
                head = [found(parts[0])] if parts[0] else []
                yield " ".join(head + [found(" " + w) for w in parts[1:]])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split()]

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(" "))) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids)


_codecs: dict[str, ByteBpe] = {}


def codec(content: bytes, pattern: str) -> ByteBpe:
    """The process's codec for a vocabulary; built once per Python worker."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = ByteBpe(load_ranks(content), pattern)
    return _codecs[key]


def forget_codecs() -> None:
    """Free the process's codecs."""
    _codecs.clear()
    gc.collect()  # a codec and its words refer to each other


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file as bytes; under 2 MB, so it is shipped with the job."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with an array column of token ids (null text: empty array)."""
    return _ids(df, vocabulary, pattern, text, ids)


def _ids(df: DataFrame, vocabulary: str, pattern: str, text: str, ids: str) -> DataFrame:
    from pyspark.sql import functions as F

    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("array<int>")
    def to_ids(column: pa.Array) -> pa.Array:
        bpe = codec(shipped.value, pattern)
        return pa.array([list(map(int, x.split())) for x in bpe.encode_many([x or "" for x in column.to_pylist()])], pa.list_(pa.int32()))

    return df.withColumn(ids, to_ids(F.col(text)))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that an array of ids stands for (null: empty)."""
    from pyspark.sql import functions as F

    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("binary")
    def to_bytes(column: pa.Array) -> pa.Array:
        bpe = codec(shipped.value, pattern)
        return pa.array([bpe.decode(x.as_py() or []) for x in column], pa.binary())

    return df.withColumn(out, to_bytes(F.col(ids)))


def round_trip_digest(docs: DataFrame, vocabulary: str, pattern: str, forget: bool = False) -> DataFrame:
    """Per document: token count, SHA-256 of the joined decimal ids, SHA-256 of the bytes decoded from those ids.

    The digest is taken where the ids are made, so that ids (several times the text) never cross to the JVM. With ``forget``
    a task's codec goes with the task: Spark keeps Python workers, and other work that follows in them has no use for it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBpe | None = codec(shipped.value, pattern)
        try:
            for batch in batches:
                count, encoded, decoded = [], [], []
                for joined in bpe.encode_column(batch.column(1)):
                    count.append(joined.count(" ") + 1 if joined else 0)
                    encoded.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode_joined(joined)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            if forget:
                bpe = None
                forget_codecs()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), DIGEST_SCHEMA)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
