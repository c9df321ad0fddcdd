"""A table that batches merge into by key, rewriting only what they touch.

Rows are dealt into hash buckets of their key. A version is a manifest: for every bucket the version
whose files hold it. A batch reads and writes the buckets of its own keys, then the manifest; files that
neither this manifest nor the one before names are removed. The same batch again, after a failure at any
point, starts from the manifest before it and writes the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.session import remove

BUCKETS = 64


class KeyedTable:
    """The table under ``base``. ``buckets`` stays as it was when the table was begun; a bucket is what one
    key's change rewrites, so their number should grow with the table."""

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = BUCKETS):
        self._spark, self._base, self._key, self._buckets = spark, base, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self._key), F.lit(self._buckets)).cast("int")

    def _data(self, version: int) -> str:
        return f"{self._base}/data/version={version}"

    def holders(self, version: int) -> dict[int, int]:
        """Bucket -> version whose files hold it; at most a row a bucket."""
        if version < 0:
            return {}
        return {r.bucket: r.holder for r in self._spark.read.parquet(f"{self._base}/manifest/version={version}").collect()}

    def last_version(self) -> int:
        return self._spark.read.parquet(f"{self._base}/manifest").agg(F.max("version")).first()[0]

    def _read(self, holders: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self._data(holder)}/bucket={bucket}" for bucket, holder in sorted(holders.items())]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        return self._read(self.holders(self.last_version() if version is None else version), schema)

    def merge(self, version: int, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write ``version``: what ``combine`` makes of the stored rows of the batch's buckets and the batch.

        ``combine`` gets both with the columns of the batch and returns those columns, keys unchanged.
        """
        schema = batch.schema
        before = self.holders(version - 1)
        touched = [r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect()]
        stored = self._read({b: before[b] for b in touched if b in before}, schema)
        merged = combine(stored, batch).select(*schema.names).withColumn("bucket", self.bucket())
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._data(version))
        after = {**before, **{b: version for b in touched}}
        manifest = self._spark.createDataFrame(sorted(after.items()), "bucket int, holder int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self._base}/manifest/version={version}")
        self._clean(version, before, after)

    def _clean(self, version: int, before: dict[int, int], after: dict[int, int]) -> None:
        """Remove what only versions before the last one named."""
        if version < 2:
            return
        older = self.holders(version - 2)
        for bucket, holder in older.items():
            if before.get(bucket) != holder and after.get(bucket) != holder:
                remove(self._spark, f"{self._data(holder)}/bucket={bucket}")
        for holder in set(older.values()) - set(before.values()) - set(after.values()):
            remove(self._spark, self._data(holder))
        remove(self._spark, f"{self._base}/manifest/version={version - 2}")
