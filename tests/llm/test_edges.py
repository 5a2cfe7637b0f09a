"""Nulls, empty and repeated texts, a very long one, clashing extra columns and empty tables, for the queries that count or score."""

import math

import pytest

from lectern.llm.language import op8_language_id
from lectern.llm.token_counts import op5_token_counts
from lectern.llm.toxicity import op3_toxicity

TEXTS = [(None, None), ("", None), ("abc def", "en"), ("abc def", "en"), ("123", None), ("x " * 30_000, "fr")]


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, edits string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, text string").write.parquet(f"{folder}/labels.parquet")


def test_defined_results(spark, tmp_path):
    tables(spark, tmp_path, [(i, t, lang, "s", "e") for i, (t, lang) in enumerate(TEXTS)], [(2, 1, "t"), (3, 0, "t"), (5, None, None)])
    scores = {r["doc_id"]: r for r in op3_toxicity(spark, str(tmp_path)).collect()}
    assert set(scores) == set(range(6))
    assert all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) and r["predicted"] == int(r["score"] >= 0.5) for r in scores.values())
    assert scores[2]["score"] == scores[3]["score"] and scores[0]["score"] == scores[1]["score"]
    counts = {r["doc_id"]: r for r in op5_token_counts(spark, str(tmp_path)).collect()}
    assert counts[0]["n_tokens_before"] == counts[1]["n_tokens_before"] == 0 and counts[2]["n_tokens_before"] == 2
    found = {r["doc_id"]: r["lang_pred"] for r in op8_language_id(spark, str(tmp_path)).collect()}
    assert [found[k] for k in (0, 1, 4)] == ["und"] * 3 and found[2] == found[3] == "en"


@pytest.mark.parametrize("query", [op3_toxicity, op5_token_counts, op8_language_id])
def test_empty_tables(spark, tmp_path, query):
    tables(spark, tmp_path, [], [])
    assert query(spark, str(tmp_path)).count() == 0
