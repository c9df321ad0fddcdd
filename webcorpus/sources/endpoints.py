"""Captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.functions import urls as U
from webcorpus.operators.json_nodes import json_facts


def read_endpoints(captured: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Data responses among captured traffic, the first per page and URL.

    ``captured`` holds (page_url, seq, url, status, content_type, body). Tracking, other
    content types and small bodies go before anything is grouped.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    data = captured.filter(
        (kind.contains("json") | F.lower("url").endswith(".json")) & ~U.is_telemetry("url")
    ).withColumn("bytes", F.octet_length("body").cast("bigint"))
    data = data.filter(F.col("bytes") >= min_bytes)
    # A top-k window of one: all but the first go before the shuffle, and what the rows are made of is made once.
    order = Window.partitionBy("page_url", "url").orderBy("seq")
    kept = data.dropna(subset=["page_url", "url", "seq"]).withColumn("_place", F.rank().over(order)).filter("_place = 1")
    return kept.select(
        "page_url", "url", "seq", "status", "content_type", "bytes", "body", json_facts("body")["is_json"].alias("is_json")
    )
