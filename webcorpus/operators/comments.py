"""Comment threads and follower lists in uniform columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.operators.json_nodes import json_nodes
from webcorpus.session import cut_lineage

_COMMENT = r"^/1/data/children/\d+(?:/data/replies/data/children/\d+)*"


def epoch_to_utc(epoch: Column | str) -> Column:
    """Timestamp of epoch seconds; NULL for zero, blank and unreadable values."""
    seconds = (F.col(epoch) if isinstance(epoch, str) else epoch).try_cast("double")
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def flatten_comments(threads: DataFrame, max_items: int | None = None, doc: str = "doc", body: str = "body") -> DataFrame:
    """Comments of listing documents, replies after their parent, in document order.

    Only comments with text count, and only below parents that count themselves.
    """
    wanted = rf"{_COMMENT}(?:/kind|/data/(?:author|body|score|created_utc))$"
    parts = cut_lineage(
        json_nodes(threads.select(doc, body), body, ("key", "scalar", "ancestors", "depth", "pointer"))
        .filter(F.col("pointer").rlike(wanted))
        .select(
            doc, "key", "scalar", "ancestors",
            F.when(F.col("key") == "kind", F.col("depth") - 1).otherwise(F.col("depth") - 2).alias("at"),
        )
    )

    def value(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("scalar")))

    comments = (
        parts.groupBy(doc, F.get("ancestors", F.col("at")).alias("comment"))
        .agg(
            value("kind").alias("kind"), value("author").alias("author"), value("body").alias("text"),
            value("score").try_cast("bigint").alias("score"), value("created_utc").alias("created"),
            # Comments sit at depths 4, 9, 14, …; those above this one are its parents.
            F.max(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(4), F.greatest(F.col("at"), F.lit(4)), F.lit(5)),
                        lambda d: F.when(d < F.col("at"), F.get("ancestors", d)),
                    ),
                    lambda p: p.isNotNull(),
                )
            ).alias("parents"),
        )
        .filter((F.col("kind") == "t1") & (F.coalesce("text", F.lit("")) != ""))
    )
    known = comments.select(doc, F.col("comment").alias("parent"))
    orphans = (
        comments.select(doc, "comment", F.explode("parents").alias("parent"))
        .join(known, [doc, "parent"], "left_anti")
        .select(doc, "comment").distinct()
    )
    kept = comments.join(orphans, [doc, "comment"], "left_anti").select(
        doc, "comment", F.coalesce("author", F.lit("")).alias("author"), "text",
        F.coalesce("score", F.lit(0)).alias("score"), epoch_to_utc("created").alias("created_at"),
    )
    order = F.row_number().over(Window.partitionBy(doc).orderBy("comment"))
    ranked = kept.withColumn("rank", order)
    return ranked.filter(F.col("rank") <= max_items) if max_items else ranked


_COMMENT_COLUMNS = {
    # platform: (author columns, text, likes, epoch seconds, ready timestamp)
    "youtube": (("author", "author_id"), "text", "like_count", "timestamp", None),
    "twitter": (("author", "author_id"), "text", "like_count", "timestamp", None),
    "tiktok": (("author", "author_id"), "text", "like_count", "timestamp", None),
    "instagram": (("username",), "text", "likes_count", None, "created_at_utc"),
}


def normalize_comments(exported: DataFrame, platform: str) -> DataFrame:
    """Platform exports as author, text, likes, created_at; other columns pass through."""
    authors, text, likes, epoch, ready = _COMMENT_COLUMNS[platform]
    used = {*authors, text, likes, epoch, ready}
    names = [F.nullif(F.col(a), F.lit("")) for a in authors if a in exported.columns]
    when = epoch_to_utc(epoch) if epoch else F.to_timestamp(ready)
    return exported.select(
        *[c for c in exported.columns if c not in used],
        F.coalesce(*names, F.lit("")).alias("author"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col(likes).try_cast("bigint"), F.lit(0)).alias("likes"),
        when.alias("created_at"),
    )


def normalize_follows(exported: DataFrame) -> DataFrame:
    """Follower or followee exports as username, full_name, private, verified."""
    return exported.select(
        *[c for c in exported.columns if c not in ("username", "full_name", "is_private", "is_verified")],
        "username", F.coalesce("full_name", F.lit("")).alias("full_name"),
        F.coalesce(F.col("is_private").cast("boolean"), F.lit(False)).alias("private"),
        F.coalesce(F.col("is_verified").cast("boolean"), F.lit(False)).alias("verified"),
    )
