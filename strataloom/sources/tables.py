"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, a new one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strataloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_own(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, a subfolder for each value of the columns `by`.

    It cuts lineage and outlives executors.
    """
    path = scratch(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Place:
    """A place on whatever file system Spark has for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def mark(self) -> None:
        """An empty file that says that something is done."""
        self.fs.create(self.path, True).close()


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    return Place(spark, f"{path}/_SUCCESS").exists()


def committed(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows of df as a Parquet table at path; what an earlier run has written there to its end is used as it is."""
    if not is_committed(df.sparkSession, path):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; what reads them must be over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
