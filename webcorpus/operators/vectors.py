"""Exact nearest neighbours by cosine, and embedding by a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.functions.text import strip

QUERY_VALUES = 2_000_000  # numbers in a block of queries
VECTOR_VALUES = 4_000_000  # numbers in a block of stored vectors
MAX_SCORES = 1_000_000  # scores a task holds at once
RANK_DIGITS = 12
GROUP = 64  # vectors whose greatest score is looked at first
PAIRS = 1 << 16  # pairs whose exact similarity is computed at once
MOST_ROWS = 1 << 20  # rows of a block, however short they are


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: positions in the column and unit vectors; zero and not finite ones are zero."""
    sizes = np.asarray(pc.list_value_length(column).combine_chunks().fill_null(0))
    out = {}
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        rows = pc.list_flatten(column.take(pa.array(at))).to_numpy().astype("float64").reshape(len(at), width)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[width] = at, np.divide(rows, norms, out=np.zeros_like(rows), where=np.isfinite(norms) & (norms > 0))
    return out


def _alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal rows, and every row's group."""
    whole = np.ascontiguousarray(rows).view(f"V{max(1, rows.shape[1] * rows.itemsize)}").ravel() if rows.shape[1] else np.zeros(len(rows), "V1")
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    return first, group


def _numbered(groups: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its group, in the order given."""
    order = np.argsort(groups, kind="stable")
    ends = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1])[:len(groups)])
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(ends, np.diff(np.append(ends, len(groups))))
    return out


def _promising(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that hold the ``k`` best of every query, by a product in single precision.

    The k-th best of the maxima of groups of vectors is a score that k vectors reach.
    """
    scores = queries.astype(np.float32) @ vectors.astype(np.float32).T
    count = len(vectors)
    groups = count // GROUP
    if groups <= k:
        return tuple(np.divmod(np.arange(scores.size), max(1, count)))
    maxima = scores[:, :groups * GROUP].reshape(len(scores), groups, GROUP).max(axis=2)
    reached = np.partition(maxima, groups - k, axis=1)[:, groups - k]
    margin = 4 * (queries.shape[1] + 8) * np.finfo(np.float32).eps
    return np.nonzero(scores >= (reached - margin)[:, None])


def _best_of_block(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For a block of queries and one of vectors: the best ``k`` rows of each query."""

    def best(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id").combine_chunks()
        stored = _units(vectors.column("vector"))
        none = np.empty(0, np.int64)
        asked, found, similarities = [none], [none], [np.empty(0)]
        for width, (at, units) in _units(queries.column("vector")).items():
            same, matrix = stored.get(width, (none, np.empty((0, width)))) if width else (none, np.empty((0, 0)))
            others = np.setdiff1d(np.arange(vectors.num_rows), same)[:k]  # similarity 0
            # Of equal vectors only the k with the smallest ids can be among the best.
            few = _numbered(_alike(matrix)[1]) < k
            mine, matrix = same[few], matrix[few]
            first, group = _alike(units)
            distinct = units[first]
            step = max(1, MAX_SCORES // max(1, len(mine)))
            rows, places, ranks = [none], [none], [none]
            for start in range(0, len(distinct), step):
                some = distinct[start:start + step]
                row, col = _promising(some, matrix, k) if len(mine) else (none, none)
                exact = np.concatenate([np.empty(0), *[
                    np.einsum("ij,ij->i", some[row[a:a + PAIRS]], matrix[col[a:a + PAIRS]]) for a in range(0, len(row), PAIRS)]])
                score = np.rint(np.clip(exact, -1.0, 1.0) * 10**RANK_DIGITS).astype(np.int64)
                row = np.concatenate([row, np.repeat(np.arange(len(some)), len(others))])
                place = np.concatenate([mine[col], np.tile(others, len(some))])
                score = np.concatenate([score, np.zeros(len(some) * len(others), np.int64)])
                order = np.lexsort([place, -score, row])
                top = order[_numbered(row[order]) < k]
                rows.append(row[top] + start)
                places.append(place[top])
                ranks.append(score[top])
            rows, places, ranks = (np.concatenate(x) for x in (rows, places, ranks))
            # Every query gets what its equals got.
            offsets = np.searchsorted(rows, np.arange(len(distinct) + 1))
            sizes = np.diff(offsets)[group]
            ends = np.cumsum(sizes)
            spots = np.repeat(offsets[group] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            asked.append(np.repeat(at, sizes))
            found.append(places[spots])
            similarities.append(ranks[spots] / 10.0**RANK_DIGITS)
        return pa.table({
            "query_id": queries.column("id").take(pa.array(np.concatenate(asked))),
            "id": vectors.column("id").take(pa.array(np.concatenate(found))),
            "similarity": pa.array(np.concatenate(similarities)),
        })

    return best


def _blocks(rows: DataFrame, values: int) -> int:
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("values")).first()
    return max(1, -(-size["values"] // values), -(-size["rows"] // MOST_ROWS))


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id",
    vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "vector",
    max_values: int = QUERY_VALUES, vector_values: int = VECTOR_VALUES,
) -> DataFrame:
    """The ``k`` most similar vectors per query: (query_id, rank, id, similarity).

    Exact, as a blocked join: queries and vectors are dealt by hash into blocks of about ``max_values``
    and ``vector_values`` numbers, every query block meets every vector block in a task of its own, and
    one matrix product there leaves ``k`` rows per query, which a rank per query merges. Queries are sent
    once for each vector block and vectors once for each query block; nothing but counts passes the
    driver. Similarities are compared at twelve decimals, then by id. Null vectors are skipped; empty
    and zero vectors, those with NaN and those of another width have similarity 0.
    """
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector"))
    stored = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    down, across = _blocks(asked, max_values), _blocks(stored, vector_values)

    def dealt(rows: DataFrame, blocks: int, mine: str, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias(mine)
        return rows.select("id", "vector", own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(asked, down, "down", "across", across).groupBy("down", "across")
    right = dealt(stored, across, "across", "down", down).groupBy("down", "across")
    query_type, id_type = (frame.schema[name].dataType.simpleString() for frame, name in ((queries, query_id), (vectors, id_col)))
    found = left.cogroup(right).applyInArrow(_best_of_block(k), f"query_id {query_type}, id {id_type}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embed(
    docs: DataFrame, function: Callable[[list[str]], list[list[float]]], key: str = "doc_id", text: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """(key, embedding) by a caller's batch function; blank texts are skipped.

    The function gets whole texts, or their first ``limit`` characters if its model takes no more.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "embedding": function(list(batch["text"]))})

    whole = F.col(text) if limit is None else F.substring(text, 1, limit)
    return docs.filter(strip(F.coalesce(text, F.lit(""))) != "").select(key, whole.alias("text")).mapInPandas(
        run, f"{key} {key_type}, embedding array<float>")
