import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import toxicity as T


def brute(scores, begin=0):
    """The best segment, then the same to its left and right."""
    n = len(scores)
    prefix = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    best = max(((prefix[b] - prefix[a], a - b, -a) for a in range(n) for b in range(a + 1, n + 1)), default=(0.0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [*brute(scores[:a], begin), (begin + a, begin + b, best[0]), *brute(scores[b:], begin + b)]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.normal(-0.3, 1.5, rng.integers(0, 40)).astype(np.float32)
        own, other = T.segments(scores), brute(scores)
        assert [x[:2] for x in own] == [x[:2] for x in other]
        assert np.allclose([x[2] for x in own], [x[2] for x in other])


def test_a_long_descent_takes_linear_time():
    scores = np.where(np.arange(400_000) % 2 == 0, 1.0, -2.0).astype(np.float32)
    assert len(T.segments(scores)) == 200_000


def test_evidence_of_many_segments_exceeds_that_of_one():
    one, n = T.evidence(np.array([9.0]), 100, 0.1)
    many, m = T.evidence(np.full(20, 9.0), 100, 0.1)
    assert n == 1 and m == 20 and many > one > 0
    assert T.evidence(np.array([]), 0, 0.1) == (0.0, 0)


def test_a_row_counts_a_token_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(T, "fit", kept.append)
    rows = [(0, 1, 0, "a a a b"), (0, 0, 2, "a a"), (1, 1, 1, "b b c"), (2, 1, 0, None), (2, 0, 1, "")]
    T.train(spark.createDataFrame(rows, "fold int, clean long, toxic long, text string"))
    assert [len(kept), *(x.sum(axis=1).tolist() for x in kept)] == [6, [2, 2], [2, 2], [4, 4], [4, 4], [4, 4], [4, 4]]


@pytest.mark.parametrize(("table", "sample", "least"), [("sf0.01", T.SAMPLE, 0.95), ("sf0.01", 300, 0.85), ("sf0.1", T.SAMPLE, 0.95)])
def test_held_out_quality(spark, monkeypatch, table, sample, least):
    monkeypatch.setattr(T, "SAMPLE", sample)
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{table}/labels.parquet")
    rows = T.score(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert len(rows) > 50
    assert (rows["predicted"] == rows["toxic"]).mean() > least


def test_ties_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (1, "good words here", 5), (2, None, 6), (3, "", 7), (None, "bad bad bad", 8), (4, "bad bad bad", 9)], "doc_id long, text string, evidence int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    rows = T.score(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[1]["score"]
    none = T.score(docs, labels.where("toxic = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert T.score(docs.where("doc_id = 99"), labels).count() == 0
