"""Keyed tables kept as Parquet by root: a root's rows replaced as a whole, or single rows changed, other roots' files left alone.

A table is a folder of (key, ..., root) rows, partitioned by root; keys are unique over all roots. Each change is worked out from
the table as it is, written beside it and then put in the place of the roots that it touches, so that doing it twice does it once
and a failed write leaves the table as it was until its files are swapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.steps import Steps
from lectern.operators.votes import keep_first


def create(rows: DataFrame, path: str, key: list[str], order: str) -> None:
    """A new table of ``rows``; the first row of a key by ``order`` stays."""
    keep_first(rows, key, order).drop(order).write.partitionBy("root").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def swap(table: DataFrame, after: DataFrame, touched: DataFrame, path: str) -> None:
    """Write the rows of ``after`` in ``touched`` roots over those of the table; a root without rows left goes."""
    spark = table.sparkSession
    steps = Steps(spark)
    whole = steps.keep(after.join(touched, "root", "left_semi").select(*table.columns))
    whole.write.partitionBy("root").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for r in touched.join(whole.select("root").distinct(), "root", "left_anti").collect():  # emptied roots: names of folders only
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/root={r['root']}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    steps.drop(whole)
    spark.catalog.refreshByPath(path)


def replace_root(table: DataFrame, root: str, rows: DataFrame, key: list[str], order: str, path: str) -> None:
    """All rows of ``root`` replaced by ``rows``; keys among them that other roots hold move here. Of repeated keys the first by ``order`` stays."""
    steps = Steps(table.sparkSession)
    new = steps.keep(keep_first(rows.withColumn("root", F.lit(root)), key, order).drop(order).select(*table.columns))
    lost = table.join(new.select(*key), key, "left_semi").select("root")
    touched = steps.keep(lost.unionByName(new.select("root")).unionByName(table.sparkSession.createDataFrame([(root,)], "root string")).distinct())
    after = table.where(F.col("root") != root).join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new)
    swap(table, after, touched, path)
    steps.drop(new, touched)


def apply_delta(table: DataFrame, upserts: DataFrame, deletes: DataFrame, key: list[str], order: str, path: str) -> None:
    """Rows of ``deletes`` (key) go, then those of ``upserts`` come or take the place of theirs; the last by ``order`` of a key counts."""
    steps = Steps(table.sparkSession)
    last = upserts.groupBy(*key).agg(F.max(F.struct(order, *[c for c in table.columns if c not in key])).alias("_l"))
    new = steps.keep(last.select(*key, *(F.col(f"_l.{c}").alias(c) for c in table.columns if c not in key)).select(*table.columns))
    gone = deletes.select(*key).unionByName(new.select(*key)).distinct()
    lost = table.join(gone, key, "left_semi").select("root")
    touched = steps.keep(lost.unionByName(new.select("root")).distinct())
    swap(table, table.join(gone, key, "left_anti").select(*table.columns).unionByName(new), touched, path)
    steps.drop(new, touched)
