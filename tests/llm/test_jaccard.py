import random
import re

import numpy as np
import pytest

from lectern.llm import jaccard


def brute(texts):
    """doc_id -> (set size, component) from the definition."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    out = {0: None, 1: "", 2: " \t\n", 3: "one", 4: "ONE", 5: "a b c d", 6: "a b c d e", 7: "é x y z", 8: "a b  c\nd"}
    for i in range(9, n):
        kind = rnd.random()
        if kind < 0.5 and i > 12:
            w = (out[rnd.randrange(9, i)] or "").split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    k = rnd.randrange(len(w))
                    w[k : k + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 6, 8, 12, 20, 50, 120, 300]))]
            if rnd.random() < 0.3:
                w[len(w) // 2 : len(w) // 2] = passage
        out[i] = rnd.choice([" ", "\n", "  "]).join(w)
    return out


@pytest.mark.parametrize(("seed", "block", "partners"), [(1, 2048, 512), (2, 3, 2)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, block, partners):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    texts = corpus(seed)
    spark.createDataFrame([(i, t, i, 0) for i, t in texts.items()], "doc_id long, text string, component_id long, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op10_ngram_jaccard(spark, str(tmp_path)).collect()}
    assert got == brute(texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert jaccard.op10_ngram_jaccard(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, text), (7, "other words than these stand here"), (9, text + " end"), (None, text), (None, "alone among all others"), (8, None)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 36, 7), (7, 2, 7), (9, 37, 7), (None, 36, 7), (None, 1, None), (8, 0, 8)}


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, jaccard.BUCKETS).astype(np.uint16)

    def shown(values):
        return {x for band in jaccard.bands(len(values)) for x in jaccard.shown(values, band, counts).tolist()}

    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 20, 31, 33, 64, 100]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        lost = rng.integers(0, n // 3 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1), dtype=np.uint64) << np.uint64(1)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert shown(a) & shown(b), (len(a), len(b), both)


def test_sets_that_share_little_are_no_candidates(spark, monkeypatch):
    """Sets that share a passage, or two thirds of their shingles, meet in many signatures, but are not written as pairs."""
    rnd = random.Random(5)
    draw = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, base = draw(400), draw(420)
    texts = [" ".join([*draw(700), *passage, *draw(700)]) for _ in range(30)]
    for _ in range(30):
        own = list(base)
        for k in rnd.sample(range(0, 420, 6), 16):
            own[k] = draw(1)[0]
        texts.append(" ".join(own))
    counted, within = [], jaccard.within

    def count(rows):
        counted.append((rows.count(), within(rows).count()))
        return within(rows)

    monkeypatch.setattr(jaccard, "within", count)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.group(rows).collect()}
    assert got == brute(dict(enumerate(texts)))
    assert counted[0][0] > 50  # the sets do meet
    assert counted[0][1] < 10
