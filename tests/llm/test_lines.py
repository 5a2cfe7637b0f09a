import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import lines


def brute(docs):
    """doc_id -> text without lines that have an earlier similar line."""
    seen, out = [], {}
    for d in sorted(docs):
        keep = []
        gone = 0
        for line in (docs[d] or "").split("\n"):
            own = frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if own and any(100 * len(own & s) >= 75 * len(own | s) for s in seen):
                gone += 1
            else:
                keep.append(line)
            if own:
                seen.append(own)
        out[d] = ("\n".join(keep) if gone else docs[d], gone)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    base, docs = [], {0: None, 1: "", 2: "\n\n", 3: " \n\t\nA b\na B\n"}
    for d in range(4, 120):
        out = []
        for _ in range(rnd.randrange(1, 9)):
            if base and rnd.random() < 0.5:
                w = list(rnd.choice(base))
                for _ in range(rnd.randrange(4)):
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            else:
                w = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 4, 8, 30, 120]))]
                base.append(w)
            out.append(" ".join(w))
        docs[d] = "\n".join(out)
    return docs


@pytest.mark.parametrize(("seed", "group", "chunk"), [(1, 1 << 14, 1 << 18), (2, 5, 40)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, group, chunk):
    monkeypatch.setattr(lines, "GROUP", group)
    monkeypatch.setattr(lines, "CHUNK", chunk)
    docs = corpus(seed)
    spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, line string").orderBy("text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    for r in lines.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        assert (r["text"], r["n_removed_lines"]) == want[r["doc_id"]], r["doc_id"]
        assert r["line"] == "x"
    for r in lines.op6_line_dedup(spark, str(tmp_path)).collect():
        text, gone = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed_lines"], r["kept_sha256"]) == (len((docs[r["doc_id"]] or "").split("\n")), gone, hashlib.sha256((text or "").encode()).hexdigest())


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c\na b c", 7, 8, 9, 1), (1, "a b c", 7, 8, 9, 1)], "doc_id long, text string, _row int, _place int, _gone int, n_lines int")
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_row", "_place", "_gone", "n_lines", "n_removed_lines"]
    assert {r[2:5] for r in got.collect()} == {(7, 8, 9)} and sum(r["n_removed_lines"] for r in got.collect()) == 2  # which row is first is up to the text's hash


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 30, 33, 60, 70, 130, 300, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)])
        sets, cut = np.concatenate([a, b]), np.array([0, len(a)])
        low, high, wide = lines.parities(sets, cut, np.array([len(a), len(b)]))
        apart = len(np.setxor1d(a, b))
        place = np.array([len(a) << 17, len(b) << 17])
        group = lines.Group(np.zeros(2, np.int64), np.arange(2), place, low.view(np.int64), high.view(np.int64), np.array(wide, dtype=object))
        _, _, got = group.candidates(np.array([1]), np.array([0]))
        assert len(got) == 1 and got[0] <= apart and got[0] >= apart // 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert lines.op6_line_dedup(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    text, near = "alpha beta gamma delta\n\nepsilon zeta eta theta", "alpha beta gamma delta\niota kappa lambda mu"
    rows = [(7, text), (7, text), (7, text), (8, "own words here now"), (9, near), (9, "one two three\none two three"), (None, "nu xi omicron pi"), (None, "nu xi omicron pi"), (None, None), (10, "nu xi omicron pi")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = lines.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed_lines"]
    want = [
        (7, text, 3, 0), (7, "", 3, 2), (7, "", 3, 2), (8, "own words here now", 1, 0), (9, "iota kappa lambda mu", 2, 1), (9, "one two three", 2, 1),
        (None, "nu xi omicron pi", 1, 0), (None, "", 1, 1), (None, None, 1, 0), (10, "", 1, 1),
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert lines.op6_line_dedup(spark, str(tmp_path)).count() == len(rows)


def test_repeated_rows_survive_the_stage(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 16), (1, "alpha beta gamma", 16), (2, "delta epsilon", 13)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.line_stage(spark, docs, "").collect())) == [(1, "alpha beta gamma", 16), (2, "delta epsilon", 13)]


def test_a_line_that_is_everywhere_is_combined_in_its_task(spark):
    docs = spark.range(0, 600, 1, 3).selectExpr("id as doc_id", "concat('all rights are reserved here\nown', id, ' w', id, ' x', id) as text")
    rows = lines.postings(docs, lines.rarity(lines.token_counts(docs), lines.SKETCH))
    whole = rows.where("place % 2 = 1").groupBy("token").count().agg({"count": "max"}).first()[0]
    assert whole <= 3
    assert sorted(map(tuple, lines.removed_lines(docs).collect())) == [(d, 0) for d in range(1, 600)]


def test_groups_larger_than_a_batch(spark):
    docs = spark.range(0, 300, 1, 3).selectExpr("id as doc_id", "concat('a b c d e f g h i j k w', id % 150, if(id % 3 = 0, concat(' v', id, ' u', id, ' t', id, ' s', id), '')) as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in lines.dedup_lines(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute({r["doc_id"]: r["text"] for r in docs.collect()})


def test_a_wide_parity_travels_alone():
    tokens = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    n = np.array([20, 50, 65, 129, 236])
    low, high, wide = lines.parities(tokens, np.cumsum(n) - n, n)
    assert [w is None for w in wide] == [True, True, False, False, False]
    assert not low[2:].any() and not high[2:].any()
    raw = np.empty(5, dtype=object)
    raw[:] = wide
    group = lines.Group(np.zeros(5, np.int64), np.arange(5), n << 17, low.view(np.int64), high.view(np.int64), raw)
    for k, first in enumerate(np.cumsum(n) - n):
        place = (tokens[first : first + n[k]] >> np.uint64(40)).astype(np.int64) & 127
        bits = np.bincount(place, minlength=128) & 1
        whole = sum(int(b) << i for i, b in enumerate(bits))
        assert int(group.folded[k]) == (whole & (1 << 64) - 1) ^ (whole >> 64)
        assert n[k] <= 32 or (int(group.low[k]), int(group.high[k])) == (whole & (1 << 64) - 1, whole >> 64)
