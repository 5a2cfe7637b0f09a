"""From raw documents to token ids: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Every stage takes all that its predecessor kept; each result is written as Parquet to the cluster's shared folder and reread.

Defined results, for every stage: an empty table gives an empty table; columns other than doc_id, text and n_chars are carried as
they are, whatever their names; n_chars is set anew where it is there. Rows with null or empty text have no language and go in
the first stage. Rows with one doc_id are documents of their own, but for the benchmark stage, which drops all of them if one
holds an item; a null doc_id is never dropped as a near duplicate or for an item. Repeated rows lose their lines to the first of
them and go in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard, language, lines
from lectern.llm.storage import Scratch

#: A document goes if it has no letter, or if no language leads clearly and the best one's share is under this.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no language."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    name = lines.unused(docs, "_found")
    found = docs.withColumn(name, language.prediction(spark, model, F.col("text")))
    unclear = F.col(f"{name}.ambiguous") & (F.col(f"{name}.score") < LEAST_LANGUAGE_SCORE)
    return found.where((F.col(f"{name}.lang_pred") != "und") & ~unclear).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing is left goes."""
    n_lines, n_removed = (lines.unused(docs, c) for c in ("_n_lines", "_n_removed"))
    held = docs.select(*(F.col(c).alias(f"_own_{c}") if c in ("n_lines", "n_removed_lines") else F.col(c) for c in docs.columns))
    out = lines.dedup_lines(held).withColumnsRenamed({"n_lines": n_lines, "n_removed_lines": n_removed})
    emptied = (F.col(n_removed) > 0) & (F.trim(F.regexp_replace("text", r"\s", " ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"_own_{c}").alias(c) if c in ("n_lines", "n_removed_lines") else F.col(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of similar ones."""
    gone = jaccard.group(docs.select("doc_id", "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), "mark").distinct()
    other = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["mark"])
    return docs.join(gone, other, "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.round_trip_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, forget=True)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of the stages' tables only the last stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.only(docs)
    return docs
