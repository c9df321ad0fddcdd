"""Stream forms of stateless and natively stateful operators, and how to run them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions import pii
from webcorpus.session import ROCKSDB, shared_dir
from webcorpus.sources.envelopes import latest_by_key, upsert_envelopes
from webcorpus.streaming.keyed_table import BUCKETS, KeyedTable

LATE_AFTER = "10 minutes"


def stream_frontier(urls: DataFrame, late_after: str | None = None, ts: str = "ts") -> DataFrame:
    """Each URL of a crawl once. With ``late_after`` state older than that is dropped."""
    if late_after:
        return urls.withWatermark(ts, late_after).dropDuplicatesWithinWatermark(["crawl_id", "url"])
    return urls.dropDuplicates(["crawl_id", "url"])


def stream_mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mask each document as it arrives; row-local, so it needs no state."""
    return pii.mask_text(docs.withColumn("spans", pii.rule_spans(text)), text, "spans").drop(text, "spans")


def stream_metrics(
    rows: DataFrame, label: str, ts: str = "ts", late_after: str = LATE_AFTER
) -> DataFrame:
    """Counts and per-second rates per label over five minutes, each minute.

    Rows later than the watermark are dropped; the delay is this library's choice.
    """
    counted = rows.withWatermark(ts, late_after).groupBy(F.window(ts, "5 minutes", "1 minute"), label).agg(
        F.count("*").alias("n")
    )
    return counted.select(label, F.col("window.end").alias("window_end"), "n", (F.col("n") / 300.0).alias("rate"))


def run_available(
    stream: DataFrame, mode: str = "append", folder: str | None = None, timeout_s: int = 600
) -> DataFrame:
    """Process everything available, then return what the stream wrote.

    A batch writes to its own folder and overwrites it when it is replayed, so a lost
    executor or driver never doubles rows.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    return _finish(spark, stream, mode, base, write, timeout_s)


def _finish(
    spark: SparkSession, stream: DataFrame, mode: str, base: str,
    write: Callable[[DataFrame, int], None], timeout_s: int,
) -> DataFrame:
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        )
        if not query.awaitTermination(timeout_s):
            query.stop()
            raise TimeoutError(f"the stream was still running after {timeout_s} s")
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.parquet(f"{base}/out").drop("batch")


def stream_jobs_to_table(
    stream: DataFrame, base: str, order: list[str], text: str = "content_md", timeout_s: int = 600, buckets: int = BUCKETS,
) -> DataFrame:
    """Mask arriving envelopes and merge them by job into a table kept under ``base``.

    A batch rewrites the buckets of its jobs only. Version N of the table is made of version N-1 and batch
    N, so a replayed batch rewrites the same version. Returns the last version.
    """
    spark = stream.sparkSession
    spans = stream.withColumn("_spans_in", pii.rule_spans(F.coalesce(text, F.lit(""))))
    masked = (
        pii.mask_text(spans, text, "_spans_in")
        .withColumn(text, F.col("masked"))
        .drop("masked", "tokens", "entities", "_spans_in")
    )
    table = KeyedTable(spark, base, "job_id", buckets)

    def combine(stored: DataFrame, newest: DataFrame) -> DataFrame:
        # The order columns stay in the table, so that a late, older update cannot win.
        known = stored.select("job_id", F.struct(*order).alias("_at"))
        newest = newest.join(known, "job_id", "left").filter(
            F.col("_at").isNull() | (F.struct(*order) >= F.col("_at"))).drop("_at")
        return upsert_envelopes(stored, newest, ("status", "content_md", "tier", "meta", *order))

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch_id, latest_by_key(batch, "job_id", order), combine)

    query = (
        masked.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream was still running after {timeout_s} s")
    return table.read(masked.schema).drop(*order)
