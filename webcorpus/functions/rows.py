"""Row expansion that keeps an expensive expression from being evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list, items: Column, pos: str | None, name: str) -> DataFrame:
    """One row per array element, with its position when ``pos`` is named.

    A plain ``explode`` makes Catalyst infer a filter on the array's size, which computes
    the array a second time for every row. The outer form infers nothing; empty rows go
    afterwards, by position, which is null for them and only for them.
    """
    position = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(
        F.col(position).isNotNull()
    )
    return out if pos else out.drop(position)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, through which no later filter is pushed.

    Without it a filter on such a column is rewritten in terms of everything it was
    computed from, and a long chain of steps turns into one enormous expression.
    """
    packed = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline_outer(packed))
