"""Weighted elections over rows of (subject, key, weight, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def elect(votes: DataFrame, subject: str, key: str, weight: Column, tie: Column | None = None) -> DataFrame:
    """Winner of each subject by most weight, its weight, the total, the number of keys and the winner's share.

    Ties go to the key with the strongest single vote, or, where ``tie`` gives a fixed order, to the least of it; then to the
    key. The share is rounded half to even to two places, 0 where nothing has weight. Null keys and weights don't vote. Votes are summed by key
    before they move; each subject then ranks its keys only.
    """
    held = votes.withColumn("_weight", weight).where(F.col(key).isNotNull() & F.col("_weight").isNotNull())
    strongest = F.min(tie) if tie is not None else -F.max("_weight")
    sums = held.groupBy(subject, key).agg(F.sum("_weight").alias("weight"), strongest.alias("_tie"))
    rank = Window.partitionBy(subject).orderBy(F.desc("weight"), "_tie", key)
    over = Window.partitionBy(subject)
    ranked = sums.withColumns({"rank": F.row_number().over(rank), "total": F.sum("weight").over(over), "candidates": F.count("*").over(over)})
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.bround(F.col("weight") / F.col("total"), 2))
    return ranked.where("rank = 1").select(subject, F.col(key).alias("winner"), "weight", "total", "candidates", share.alias("share"))


def consensus(rows: DataFrame, subject: str, key: str, percent: int) -> DataFrame:
    """Subjects of which one key has at least ``percent`` of the rows, with that key and its count."""
    won = elect(rows, subject, key, F.lit(1))
    return won.where(F.col("weight") * 100 >= F.col("total") * percent)


def resolve_field(rows: DataFrame, subject: str, value: str, weight: str, source: str, hard: str, order: str) -> DataFrame:
    """Value of each subject's field by weighted evidence: (subject, value, share, source).

    Values are the same if they differ in case or white space only; the spelling that comes first by ``order`` is shown. Blank
    or null values and weights that are null or not over 0 don't vote; where a hard vote is left, hard votes alone decide. Most
    weight wins, then the strongest single vote, then the key; the share is rounded half to even to two places; the source is
    that of the winner's heaviest vote, the first of them. A subject without votes keeps a row: null, 0, null. A null in
    ``hard`` is soft. Case is that of lower(), so that sharp s and ss differ. Votes are summed by key before they move.
    """
    key = F.trim(F.regexp_replace(F.lower(value), r"(?U)[\s\x1c-\x1f]+", " "))
    votes = F.coalesce((key != "") & (F.col(weight) > 0), F.lit(False))
    level = F.when(~votes, 0).when(F.coalesce(F.col(hard), F.lit(False)), 2).otherwise(1)
    held = rows.select(F.col(subject).alias("_s"), F.when(votes, key).alias("_key"), level.alias("_level"), F.col(weight).alias("_w"), F.struct(order, value).alias("_shown"), F.struct(-F.col(weight), order, source).alias("_from"))
    sums = held.groupBy("_s", "_key", "_level").agg(F.sum("_w").alias("_sum"), F.max("_w").alias("_most"), F.min("_shown")[value].alias("_value"), F.min("_from")[source].alias("_source"))
    over = Window.partitionBy("_s")
    pool = sums.withColumn("_top", F.max("_level").over(over)).where("_level = _top")
    rank = F.row_number().over(over.orderBy(F.desc("_sum"), F.desc("_most"), "_key"))
    ranked = pool.withColumns({"_rank": rank, "_total": F.sum("_sum").over(over)}).where("_rank = 1")
    some = F.col("_level") > 0
    share = F.when(some, F.bround(F.col("_sum") / F.col("_total"), 2)).otherwise(0.0)
    return ranked.select(F.col("_s").alias(subject), F.when(some, F.col("_value")).alias("value"), share.alias("share"), F.when(some, F.col("_source")).alias("source"))


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``, by a sortable aggregate so that rows are combined before they move."""
    value = F.struct(*order, *[c for c in rows.columns if c not in {*order, *keys}])
    return rows.groupBy(*keys).agg(F.min(value).alias("_first")).select(*keys, "_first.*")
