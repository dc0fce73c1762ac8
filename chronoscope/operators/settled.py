"""Results that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs on one machine (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        java_dir = context._jsc.sc().getCheckpointDir()
        if java_dir.isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="chronoscope-"))
            java_dir = context._jsc.sc().getCheckpointDir()
        found = java_dir.get()
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder that all executors share, so that every use sees the same rows and a lost executor costs nothing."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


class Kept:
    """Tables that belong together, in a folder of their own in the shared one; ``remove`` deletes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df as a table of this folder, written once and split by columns; filters on these read only their files."""
        path = f"{self.folder}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}").select(*like.columns)

    def remove(self) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
