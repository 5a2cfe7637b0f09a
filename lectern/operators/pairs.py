"""Pairs of sets that share an element, each found once and never shuffled.

Sets meet at every element they share; a pair is kept only where they meet at the first one that the left set lists, so that no
grouping of pairs is needed. For that every element's row carries its set, and a bit map of the set's other elements that spares
most pairs the comparison; sets of over ``SMALL`` elements don't, their pairs are
grouped. Elements that many sets hold are cut into slots, so that no task has all pairs of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The largest sets that rows carry, and how many left sets of one element meet its right ones in one slot.
SMALL, SLOT = 64, 4096


def elements(rows: DataFrame, block: list[str], owner: str, element: str) -> DataFrame:
    """(block, owner, element, n, held): distinct elements of each set with its size and, in small sets, all elements; null elements count only in n."""
    # rows stay with their owner: the distinct rows, their count and their lists take one shuffle
    known = rows.select(*block, owner, element).where(F.col(owner).isNotNull()).repartition(owner, *block).distinct()
    of = Window.partitionBy(*block, owner)
    counted = known.withColumn("n", F.count("*").over(of)).where(F.col(element).isNotNull())
    return counted.withColumn("held", F.collect_list(F.when(F.col("n") <= SMALL, F.col(element))).over(of))


def others(held: str, element: str) -> Column:
    """Bit map of what a set holds besides an element."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(F.array_remove(held, F.col(element)), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))


def between(left: DataFrame, right: DataFrame, block: list[str], element: str, own: bool) -> DataFrame:
    """(a, b, shared, united) of ``elements`` of two sides; ``own``: of one table, so that only a < b counts."""
    keys = [*block, element]
    slots = left.groupBy(*keys).agg(F.ceil(F.count("*") / SLOT).cast("int").alias("_slots")).where("_slots > 1")
    cut = lambda d: d.join(F.broadcast(slots), keys, "left")  # at most a row for SLOT rows
    a = cut(left).withColumn("_slot", F.pmod(F.xxhash64("a"), F.coalesce("_slots", F.lit(1))).cast("int")).drop("_slots")
    b = cut(right).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))).drop("_slots")
    # as many tasks as the session has partitions: the rows are few, their pairs are not
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (d.repartition(parts, *keys, "_slot").withColumn(f"rest_{s}", others(f"held_{s}", element)) for s, d in (("a", a), ("b", b)))
    met = lambda x, y: x.join(y, [*keys, "_slot"]).where("a < b" if own else "true")
    small = lambda d, n: d.where(F.col(n) <= SMALL)
    large = lambda d, n: d.where(F.col(n) > SMALL)
    both, one = F.array_intersect("held_a", "held_b"), F.col("rest_a").bitwiseAND(F.col("rest_b")) == 0
    first = one | (F.get(both, F.lit(0)) == F.col(element))
    found = met(small(a, "n_a"), small(b, "n_b")).where(first).select("a", "b", "n_a", "n_b", F.when(one, 1).otherwise(F.size(both)).cast("long").alias("shared"))
    rest = met(large(a, "n_a").drop("held_a", "rest_a"), b.drop("held_b", "rest_b")).unionByName(met(small(a, "n_a").drop("held_a", "rest_a"), large(b, "n_b").drop("held_b", "rest_b")))
    rest = rest.groupBy(*block, "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).drop(*block)
    return found.unionByName(rest).select("a", "b", "shared", (F.col("n_a") + F.col("n_b") - F.col("shared")).alias("united"))


def side(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """``elements`` under the names of one side; all columns are new ones, so that a table can meet itself."""
    names = {owner: name, "n": f"n_{name}", "held": f"held_{name}"}
    return rows.select(*(F.col(c).alias(names.get(c, c)) for c in rows.columns))


def between_sets(left: DataFrame, right: DataFrame, block: list[str], owner: str, element: str) -> DataFrame:
    """(a, b, shared, united): sets of ``left`` and of ``right`` of one block that share an element. Null owners and blocks have no pairs, null elements count in united only."""
    return between(side(elements(left, block, owner, element), owner, "a"), side(elements(right, block, owner, element), owner, "b"), block, element, own=False)


def of_sets(rows: DataFrame, block: list[str], owner: str, element: str) -> DataFrame:
    """(a, b, shared, united): pairs a < b of sets of one table and block, as in ``between_sets``."""
    held = elements(rows, block, owner, element)
    return between(side(held, owner, "a"), side(held, owner, "b"), block, element, own=True)
