"""Envelope tables: the stored form of a job and its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U


def redact_log_urls(logs: DataFrame, columns: tuple[str, ...] = fixed.LOGGED_URL_COLUMNS) -> DataFrame:
    """Reduce the URL columns of a log table to scheme, host and path."""
    return logs.withColumns({c: U.redact_url(c) for c in columns if c in logs.columns})


def public_meta(meta: Column | str) -> Column:
    return F.map_filter(U._col(meta), lambda key, _: ~key.isin(*fixed.SECRET_META_KEYS))


def public_view(envelopes: DataFrame) -> DataFrame:
    """Envelopes without the per-job secrets kept in ``meta``."""
    return envelopes.withColumn("meta", public_meta("meta"))


def latest_by_key(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key, as a partial aggregation: a hot key never fills one task."""
    payload = F.struct(*updates.columns)
    return (
        updates.groupBy(key)
        .agg(F.max_by(payload, F.struct(*order)).alias("row"))
        .select("row.*")
    )


def upsert_envelopes(
    target: DataFrame,
    updates: DataFrame,
    updated: tuple[str, ...] = ("status", "content_md", "tier", "meta"),
    key: str = "job_id",
) -> DataFrame:
    """Merge envelopes by job. On conflict only ``updated`` columns change.

    ``updates`` holds one row per job; reduce a batch with :func:`latest_by_key` first.
    Secrets in ``meta`` are dropped before they reach the store.
    """
    fresh = public_view(updates) if "meta" in updates.columns else updates
    columns = [c for c in target.columns if c != key]
    old = target.select(key, F.struct(*columns).alias("old"))
    new = fresh.select(key, F.struct(*[c for c in columns if c in fresh.columns]).alias("new"))
    merged = old.join(new, key, "full_outer")
    picked = []
    for column in columns:
        if column not in fresh.columns:
            picked.append(F.col(f"old.{column}").alias(column))
        elif column in updated:
            value = F.when(F.col("new").isNotNull(), F.col(f"new.{column}"))
            picked.append(value.otherwise(F.col(f"old.{column}")).alias(column))
        else:
            value = F.when(F.col("old").isNotNull(), F.col(f"old.{column}"))
            picked.append(value.otherwise(F.col(f"new.{column}")).alias(column))
    return merged.select(key, *picked)


def attach_embeddings(
    envelopes: DataFrame, vectors: DataFrame, key: str = "job_id", column: str = "embedding"
) -> DataFrame:
    """Set the embedding of known jobs; vectors without a job change nothing."""
    new = vectors.select(key, F.col(column).alias("_new"))
    if column not in envelopes.columns:
        return envelopes.join(new, key, "left").withColumnRenamed("_new", column)
    return (
        envelopes.join(new, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .drop("_new")
    )
