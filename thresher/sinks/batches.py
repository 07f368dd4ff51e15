"""A sink that may be asked to write a batch again: each batch counts once.

A batch has a folder of its own, which writing it again replaces, and counts
from when the manifest has its number; a batch that failed on the way has a
folder and no number, and is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchSink:
    """Batches in a folder of any store that Spark writes, each known by a number, as `foreachBatch` gives it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> list[int]:
        """The numbers of the batches that count."""
        _, path, fs = self._files()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch, unless it counts already; whether it was written. Given to `foreachBatch` as it is."""
        jvm, path, fs = self._files()
        mark = jvm.org.apache.hadoop.fs.Path(path, str(batch))
        if fs.exists(mark):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        fs.create(mark, True).close()
        return True

    def read(self) -> DataFrame | None:
        """The rows of all batches that count, with their number; None before the first."""
        done = self.done()
        if not done:
            return None
        folders = [f"{self.path}/data/batch={n}" for n in done]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).withColumn("batch", F.col("batch").cast("long"))
