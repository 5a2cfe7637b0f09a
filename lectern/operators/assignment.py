"""One-to-one assignment of new rows to known ones by what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.steps import Steps


def greedy(edges: DataFrame, order: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The edges that a greedy choice by ``order`` (then a, b) takes: each end is used once.

    Instead of one pass over all sorted edges, in rounds: an edge is taken when it comes first at both of its ends, and the
    edges of its ends leave. No edge before it can touch its ends any more, so that the taken edges are those of the pass. Each
    round takes at least the first edge left. Ends are ranked by a minimum, which is combined before rows move. Edges with a
    null end or a null in the order don't count, repeated ones count once.
    """
    steps = Steps(edges.sparkSession)
    rank = F.struct(*order, a, b)
    left = steps.keep(edges.where(F.concat(*(F.col(c).cast("string") for c in {*order, a, b})).isNotNull()).select(*order, a, b).distinct())
    taken = None
    while left.limit(1).count():
        first = lambda end, name: left.groupBy(end).agg(F.min(rank).alias(name))  # noqa: E731, B023
        chosen = first(a, "edge").join(first(b, "edge").drop(b), "edge").select("edge.*")
        taken = steps.keep(chosen) if taken is None else steps.keep(taken.unionByName(chosen), taken)
        left = steps.keep(left.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti").select(*left.columns), left)
    return edges.select(*order, a, b).where("false") if taken is None else taken


def reassociate(new: DataFrame, known: DataFrame, owner: str, parts: list[str]) -> DataFrame:
    """(owner, known, shared, united): each owner of ``new`` with at most one of ``known``, which no other has.

    Pairs share at least one part (all columns of ``parts`` equal; nulls are equal to nulls); the largest Jaccard similarity of
    the part sets goes first, then more shared parts, then the smaller ids. Owners without a partner have nulls. Repeated
    parts of an owner count once; null owners are left out.
    """
    key = F.xxhash64(*parts).alias("_key")
    sides = [d.where(F.col(owner).isNotNull()).select(F.col(owner).alias(name), key, *parts).distinct() for d, name in ((new, "a"), (known, "b"))]
    n_a, n_b = (s.groupBy(name).agg(F.count("*").alias(f"n_{name}")) for s, name in zip(sides, "ab", strict=True))
    x, y = (s.select(name, "_key", F.struct(*parts).alias(f"_{name}")) for s, name in zip(sides, "ab", strict=True))
    shared = x.join(y, "_key").where(F.col("_a").eqNullSafe(F.col("_b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = shared.join(n_a, "a").join(n_b, "b").withColumn("united", F.col("n_a") + F.col("n_b") - F.col("shared"))
    ordered = pairs.select("a", "b", (-F.col("shared") / F.col("united")).alias("_score"), (-F.col("shared")).alias("_shared"), "united")
    taken = greedy(ordered, ["_score", "_shared", "united"])
    found = taken.select(F.col("a").alias(owner), F.col("b").alias("known"), (-F.col("_shared")).alias("shared"), "united")
    return new.where(F.col(owner).isNotNull()).select(owner).distinct().join(found, owner, "left")
