"""Places of all rows of a table, or of its parts, in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.steps import kept


def place(rows: DataFrame, order: list[str], name: str = "place", within: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place from 1 by ``order``, within each part by the columns of ``within``: a rank in each range of the order plus the part's rows in the ranges before it.

    ``order`` should name a part's rows uniquely; equal rows stay in one range and get places in any order. A part of any size is
    spread over ranges. Nulls in ``within`` make a part.
    """
    ranged = kept(rows.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # parts in order: only the first one of a range has rows before it, so this is a row a range at most
    starts = counts.withColumn("_before", earlier).where("_before is not null").select("_range", *(F.col(c).alias(f"_of_{c}") for c in within), "_before")
    same = F.col("_range") == F.col("_at")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rank = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    met = ranged.withColumn("_rank", rank).join(F.broadcast(starts.withColumnRenamed("_range", "_at")), same, "left")
    return met.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_rank")).select(*rows.columns, name)
