"""Intermediate tables of one operator call, in a folder of their own in the shared directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webcorpus.session import release, shared_dir


def settled(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` as a table of its own; with ``free``, for large ones, its shuffle files go at once."""
    return Scratch(df.sparkSession).keep(df, free)


class Scratch:
    """Tables that cut lineage: any executor can be lost without repeating what is before them.

    ``keep`` writes a table and lets go of the shuffle files that made it, which Spark removes with
    their last reference. ``drop`` removes tables once all that was made of them is written.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._paths: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, free: bool = True) -> DataFrame:
        path = f"{self._folder}/{len(self._paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        if free:
            release(self._spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for k, (held, path) in enumerate(self._paths):
                if held is table:
                    at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                    at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)
                    self._paths[k] = (None, path)
