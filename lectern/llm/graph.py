"""Connected components by label propagation with pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) of every id of ``edges`` (a, b): the smallest id that links reach from it.

    Repeated, reversed and self edges are harmless; no edges give no rows. Each round halves what a chain has left. A hub is a
    key with many rows in the join with its neighbours' labels, which the adaptive skew join splits; minima are taken before
    rows move.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
    both = scratch.keep(both.where("id <> other").distinct())
    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    label = scratch.keep(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component"), F.lit(None).cast("long").alias("old")))
    while True:
        now = label.select("id", "component")
        near = both.join(now.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = now.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = scratch.keep(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component"), "old"))
        scratch.drop(label)
        label = new
        if not new.where("component <> old").limit(1).count():
            scratch.drop(both)
            return new.select("id", "component").unionByName(loops.join(new, "id", "left_anti").distinct())
