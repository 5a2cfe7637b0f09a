"""Removal of repeated passages of words against brute force."""

import hashlib
import random
import re

import pytest

from lectern.llm import passages
from lectern.llm.storage import Scratch


def brute(rows, k=20):
    """Rows (doc_id, text) in order; per row doc_id, words, removed words, digest."""
    said = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen, out = set(), []
    for (doc_id, _), words in zip(rows, said, strict=True):
        gone = [False] * len(words)
        for s in range(len(words) - k + 1):
            window = tuple(words[s : s + k])
            if window in seen:
                gone[s : s + k] = [True] * k
            seen.add(window)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    few, many = [f"w{k}" for k in range(3)], [f"v{k}é" for k in range(400)]
    base = [rng.choices(rng.choice([few, many, many]), k=rng.choice([19, 20, 21, 60, 300])) for _ in range(12)]
    texts = [None, "", " \t ", "one two", "same " * 500, "same " * 30]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            parts += rng.choice([b, b[s:], b[:s], rng.choices(many, k=rng.randrange(30)), b + b])
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, tmp_path, seed):
    rows = [(k * 3 - 50, t) for k, t in enumerate(corpus(seed))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, kept string").repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, passages.op12_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


def test_repeated_and_null_ids_and_the_texts_that_stay(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices([f"u{k}" for k in range(90)], k=n)) for n in (50, 40, 25))
    rows = [(None, a), (None, a), (1, f"{a} {b}"), (1, f"{b} {c}"), (2, f"x {a} y"), (2, f"x {a} y")]
    out = passages.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    gone = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in out)
    assert [g for g in gone if g[0] == 0] == [(0, 50, 0), (0, 50, 50)]
    assert sum(g[2] for g in gone if g[0] == 1) == 50 + 40
    assert sorted(g for g in gone if g[0] == 2) == [(2, 52, 50), (2, 52, 52)]
    assert sorted(r["kept"] for r in out if r["doc_id"] == 2) == ["", "x y"]


def test_paths_are_compacted(spark):
    rng = random.Random(3)
    a, b = ([f"{name}{k}" for k in rng.sample(range(900), 200)] for name in "pq")
    rows = [(1, a), (2, ["x", *a]), (3, a[:100] + b), (4, b)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = passages.paths(docs, "doc_id", Scratch(spark)).orderBy("row", "start").collect()
    # 200 words are 181 windows; the first 81 occur three times
    assert [(r["row"], r["start"], r["n"], r["times"]) for r in found] == [(1, 0, 81, 3), (1, 81, 100, 2), (3, 100, 181, 2)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, passages.op12_substring_dedup(spark, "/root/testdata/sf0.01").collect())) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert passages.op12_substring_dedup(spark, str(tmp_path)).count() == 0
