"""Intermediate results of operators that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one (as in tests) gets one of its own, a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Steps:
    """Tables of one operator's run, written to the shared folder as Parquet, which cuts their lineage, and deleted when replaced.

    A table that the operator's result still reads stays.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, *replaced: DataFrame) -> DataFrame:
        """``df`` written and read back; the tables that it replaces are deleted."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        self.drop(*replaced)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1])
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    return Steps(df.sparkSession).keep(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as the session has partitions: names are small, so that Spark reads many rows in few tasks, but slow to cut."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
