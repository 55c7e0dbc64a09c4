"""Intermediate tables in the cluster-shared folder, dropped when spent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstile.session import scratch_path


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables under ``spark.checkpoint.dir`` and drops spent ones.

    A written table cuts the lineage: a lost executor repeats only the work
    after it.  Tables that a returned frame still reads are kept.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.job}-{name}")
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")        # what the write shuffled is of no use once it is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df))
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
