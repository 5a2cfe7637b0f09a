"""Trees and graphs as edge tables: closure, inheritance from the nearest ancestor, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.steps import Steps, kept


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) from (child, parent), the node itself at distance 0; one join a level, until no ancestor is new.

    An ancestor reached in several ways stands once, at its least distance, so cycles end too.
    """
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    out = level = kept(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    distance = 0
    while True:
        distance += 1
        up = level.join(edges, level["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        level = kept(up.join(out.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)


def nearest(closed: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value, distance): the value of (ancestor, value) that stands nearest above each node, itself included."""
    found = closed.join(values, "ancestor").groupBy("node").agg(F.min(F.struct("distance", "value")).alias("m"))
    return found.select("node", "m.value", "m.distance")


def neighbourhood(edges: DataFrame, start: str, hops: int, budget: int) -> DataFrame:
    """(node, hop, omitted) within ``hops`` undirected steps of ``start``: at most ``budget`` nodes by hop and id, and how many more there are."""
    steps = Steps(edges.sparkSession)
    both = steps.keep(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    front = seen
    for hop in range(1, hops + 1):
        near = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        front = steps.keep(near.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    omitted = max(0, seen.count() - budget)
    return seen.orderBy("hop", "node").limit(budget).withColumn("omitted", F.lit(omitted).cast("long"))


def aliases(pairs: DataFrame) -> DataFrame:
    """(name, canonical): each name of (name, target) followed to the end of its chain, by pointer doubling; one row a name.

    Names on a cycle, or leading into one, get the cycle's smallest name; of several targets of a name the smallest counts.
    """
    # low: the smallest name among those passed on the way to ``to``, the name itself included
    steps_kept = Steps(pairs.sparkSession)
    jump = steps_kept.keep(pairs.where("name is not null and target is not null").groupBy("name").agg(F.min("target").alias("to")).withColumn("low", F.col("name")))
    names, steps = jump.count(), 1
    while True:
        ahead = jump.select(F.col("name").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        both = jump.join(ahead, "to", "left")
        if steps >= names or not both.where("far is not null").limit(1).count():  # what is still on its way now is on a cycle
            return both.select("name", F.coalesce("far_low", "to").alias("canonical"))
        jump, steps = steps_kept.keep(both.select("name", F.coalesce("far", "to").alias("to"), F.least("low", "far_low").alias("low")), jump), 2 * steps


def running(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """``start`` and ``end`` of each row's value laid after those before it within its part."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(value).over(w)).withColumn("start", F.col("end") - F.col(value))
