"""Where intermediate results are kept: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a local session (as in tests) gets one, a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run, each written to the shared folder as compressed Parquet and read from there, which cuts its lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
            self.tables.remove((df, path))

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*(df for df, _ in self.tables if not any(df is t for t in tables)))


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read from there; cuts its lineage."""
    return Scratch(spark).keep(df)
