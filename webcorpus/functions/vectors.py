"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.urls import _col


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine similarity; 0 for empty, unequal-length or zero vectors."""
    a, b = _col(left), _col(right)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    comparable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(
        F.coalesce(comparable, F.lit(False)),
        F.when(norm != 0, _dot(a, b) / norm).otherwise(F.lit(0.0)),
    ).otherwise(F.lit(0.0))
