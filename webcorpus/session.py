"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 100_000
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
LARGE_TABLE = 128 << 20  # bytes of a written table from which on the shuffle files that made it are worth a pause
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = 8, name: str = "webcorpus", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEBCORPUS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        # Page rows are wide: small Arrow batches keep a Python worker's memory flat.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.webcorpus.spread", str(cores))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, whose
    executors live in this very process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="webcorpus-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see what is no longer referenced, now and not when the driver's heap is full.

    Shuffles hang on plans and plans on Python objects, so it takes more than one collection to reach
    all of them, and the cleaner a moment to act.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def _written(spark: SparkSession, path: str) -> None:
    """What made a large table goes at once: its shuffle files would else stay until the driver's heap is full."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() >= LARGE_TABLE:
        release(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    The table outlives any executor. Unlike a checkpointed RDD it can be read column by
    column, and its size tells Catalyst which joins may broadcast. :func:`discard` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**PACKED).parquet(path)
    _written(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as a table in the shared folder, in as many buckets of ``keys`` as there are shuffle partitions.

    Joins by the keys shuffle the other side only. The table is known to this session alone. :func:`discard` removes it.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.options(**PACKED).option("path", path).saveAsTable(name)
    _written(spark, path)
    out = spark.table(name)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``cut_lineage`` or ``bucketed`` wrote, once all that was made of them is written."""
    for table in tables:
        remove(table.sparkSession, table._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of ours, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Narrow rows dealt out to as many tasks as there are cores, and more where one would get over ``rows``.

    A file of one row group is read by one task; work that costs far more per row than moving it, or that
    sorts what it makes of the rows, is then shared, and a task's memory stays the same as the table grows.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Deal a table out to ``parts`` partitions, if the caller or ``spark.webcorpus.spread`` asks for it.

    For work that costs far more per row than moving it, over tables of a few files. Clusters leave
    the setting alone; sessions of :func:`local_session` set it to their cores.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.webcorpus.spread", "0"))
    return df.repartition(parts) if parts else df
