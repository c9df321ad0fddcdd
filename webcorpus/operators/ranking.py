"""Order-dependent values that stay exact when one key holds most of the rows.

A plain window sorts a whole key in one task. Here a key is cut into slices of its order
column: windows run per (key, slice), and only one summary row per slice crosses slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prefix(
    df: DataFrame, keys: list[str], slice_col: str, totals: dict[str, Column], combine: dict[str, str]
) -> DataFrame:
    """Add, per total, what all earlier slices of the key sum or max up to (NULL for none)."""
    per_slice = df.groupBy(*keys, slice_col).agg(*[c.alias(f"_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max}
    prefixes = per_slice.select(
        *keys, slice_col, *[fold[combine[n]](f"_{n}").over(before).alias(n) for n in totals]
    )
    return df.join(prefixes, [*keys, slice_col])


def sliced_row_number(
    df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], name: str = "n"
) -> DataFrame:
    """Row number per key. ``slice_of`` must not decrease along ``order``."""
    sliced = df.withColumn("_slice", slice_of)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_local", F.row_number().over(local))
    joined = with_prefix(numbered, keys, "_slice", {"_before": F.count("*")}, {"_before": "sum"})
    return joined.withColumn(
        name, (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint")
    ).drop("_slice", "_local", "_before")
