"""The query catalogue: every operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from webcorpus.session import dealt, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("urls", "html", "text", "privacy", "records", "crawl", "fetchlog", "storage", "jobs",
           "stateful")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``(spark, sf_dir) -> DataFrame`` under a name, with SQL where it exists."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table for work that costs much per row: texts, pages, generated notes."""
    return spread(table(spark, sf_dir, name, *columns))


def dealt_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of keys that pages and URLs are made of, for work that costs much per row."""
    return dealt(table(spark, sf_dir, name, *columns))


def load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
