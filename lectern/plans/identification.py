"""Queries that tell which rows are the same: re-association of snapshots, similar names, scores of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import assignment, scoring
from lectern.plans.registry import query
from lectern.sources.tables import table


@query(None)
def reassociate_greedy(spark, d):
    """Each order of the later snapshot with at most one of the earlier one, by shared parts of one supplier; every third order has a new id."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    later = rows.where("l_linenumber % 7 <> 0").withColumn("l_orderkey", F.col("l_orderkey") + F.when(F.col("l_orderkey") % 3 == 0, 1_000_000_000).otherwise(0))
    return assignment.reassociate(later, rows.where("l_linenumber % 5 <> 0"), "l_orderkey", ["l_partkey", "l_suppkey"])


@query(None)
def similar_names(spark, d):
    """Pairs of part names, each with its type, of one size and brand, whose ratio is at least 0.85."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")
    return scoring.similar_pairs(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", name), "p_partkey", "name", ["p_size", "p_brand"], 0.85)


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Books and what four catalogues return for them: a supplier of a part is a result, its line the edition.

    Results of every fifth supplier carry another part's name, of every third one an edition mark or a year.
    """
    part = table(spark, d, "part")
    isbn = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    books = part.select(
        F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("authors"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("B0"), F.col("p_partkey").cast("string"))).alias("asin"), F.when(F.col("p_size") % 5 == 0, isbn).alias("isbn"),
        F.round(F.col("p_retailprice") * 1000).cast("long").alias("duration_ms"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 4 == 0).alias("abridged"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
    other = part.select(F.col("p_partkey").alias("o_key"), F.col("p_name").alias("o_name"))
    mine = part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_retailprice")
    rows = lines.join(mine, "l_partkey").withColumn("o_key", F.when(F.col("l_suppkey") % 5 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey"))).join(other, "o_key", "left")
    name = F.coalesce("o_name", "p_name")
    k = F.col("l_suppkey")
    title = F.when(k % 3 == 0, F.concat(name, F.lit(" (Unabridged)"))).when(k % 3 == 1, F.concat(F.lit("1987 - "), name)).otherwise(name)
    results = rows.select(
        F.col("l_partkey").alias("book"), k.alias("result"), F.element_at(F.array(*map(F.lit, ("one", "two", "three", "four"))), (k % 4 + 1).cast("int")).alias("provider"), title.alias("title"), F.array("p_brand").alias("authors"),
        F.when(k % 6 > 0, F.round(F.col("p_retailprice") * 1000 + (k % 11 - 5) * 80_000).cast("long")).alias("runtime_ms"), F.when(k % 9 == 0, F.concat(F.lit("B0"), F.col("l_partkey").cast("string"))).alias("asin"),
        F.when(k % 8 == 0, F.concat(F.lit("978-"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"))).alias("isbn"), (k % 10 == 0).alias("abridged"),
    )
    return books, results


AUTHORITY = {"two": 0, "one": 1, "four": 2}


@query(None)
def identify_confidence(spark, d):
    """Confidence, signals and best result of every book."""
    found = scoring.identify(*candidates(spark, d), "book", "result", AUTHORITY)
    return found.withColumn("signals", F.array_join(F.transform("signals", lambda s: F.concat_ws("|", s["name"], s["points"].cast("string"), s["detail"])), ";"))


@query(None)
def rank_results(spark, d):
    """Every result of every book with its place."""
    found = scoring.ranking(scoring.scored(*candidates(spark, d), "book", "result"), "book", "result")
    return found.select("book", "result", F.round("score", 6).alias("score"), "place")


@query("""WITH b AS (SELECT *, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE (p_partkey % 10) / 10.0 END END::DOUBLE AS a, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE (p_partkey % 8) / 8.0 END ELSE 0 END::DOUBLE AS s FROM part)
SELECT p_partkey, CAST(round_even(least(1.0::DOUBLE, greatest(a, s) + CASE WHEN a > 0 AND s > 0 THEN 0.1 ELSE 0.0 END::DOUBLE) * CASE WHEN p_size % 13 = 0 THEN 0.7 WHEN p_size % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE
* CASE WHEN p_size % 7 > 0 AND p_size % 13 > 0 AND p_size % 11 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE * 100, 0) AS BIGINT) AS confidence FROM b""")
def identity_confidence(spark, d):
    """How sure every book's identity is, by where its fields come from and what speaks against them."""
    size, key = F.col("p_size"), F.col("p_partkey")
    author = F.when(size % 7 == 0, "Chapter 3").otherwise(F.col("p_brand"))
    title = F.when(size % 13 == 0, None).when(size % 11 == 0, F.concat(F.upper("p_brand"), F.lit("."))).otherwise(F.col("p_name"))
    source = F.when(size % 4 == 0, "manual").when(size % 4 == 1, "tag").otherwise("directory")
    score = scoring.identity_confidence(F.array(author), source, (key % 10) / 10, F.when(size % 3 > 0, F.col("p_type")), F.when(size % 2 == 0, "datafile").otherwise("graphing"), (key % 8) / 8, title, F.when(size % 5 == 0, "contradict").otherwise("agree"))
    return table(spark, d, "part").select("p_partkey", score.alias("confidence"))
