"""Reversible bulk edits as log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_field(rows: DataFrame, key: str, field: str, value: Column, where: Column) -> DataFrame:
    """Log (key, field, old_value, new_value) of the rows that a bulk edit would change; equal values are no change."""
    made = rows.where(where).select(key, F.lit(field).alias("field"), F.col(field).cast("string").alias("old_value"), value.cast("string").alias("new_value"))
    return made.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def undo(log: DataFrame, batch: str, key: str, order: str, old: str) -> DataFrame:
    """Value to restore for each (batch, key): the old value of its earliest entry."""
    return log.groupBy(batch, key).agg(F.min_by(old, order).alias("restored"), F.count("*").alias("n_changes"))


def remap(rows: DataFrame, field: str, mapping: dict[str, str | None]) -> DataFrame:
    """Rows with a vocabulary field renamed or merged by ``mapping``; a value mapped to None goes."""
    known = [k for k in mapping]
    to = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else None
    new = F.when(F.col(field).isin(*known), to[F.col(field)]).otherwise(F.col(field)) if mapping else F.col(field)
    return rows.withColumn(field, new).where(F.col(field).isNotNull())
