"""Flat records out of arbitrary JSON, each document in its own row."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from json.encoder import encode_basestring_ascii

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus import fixed
from webcorpus.functions.urls import cut_fragment
from webcorpus.operators.json_nodes import rank_endpoints, score_endpoints
from webcorpus.session import cut_lineage

NO_DATA_ERROR = "no data endpoint: only tracking responses were captured"
CHUNK = 4096  # records handed on at once
#: lower-case name -> (field number, priority) of the fields it can name
_NAMES: dict[str, list[tuple[int, int]]] = {}
for _field, (_names, _) in enumerate(fixed.RECORD_FIELDS.values()):
    for _priority, _name in enumerate(_names):
        _NAMES.setdefault(_name, []).append((_field, _priority))
_PREFER = [prefer for _, prefer in fixed.RECORD_FIELDS.values()]
_NO_CELLS = (None,) * 4
_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", list: "array"}


class _Closed(dict):
    """An object, once the parser has met its end, with what its surroundings need to know of it."""

    __slots__ = ("size", "best", "rich")


class _Sums:
    """The same of an array."""

    __slots__ = ("size", "best", "rich")


def _scalar_size(value: object) -> int:
    if type(value) is str:
        return len(encode_basestring_ascii(value))
    if type(value) is int:
        return len(str(value))
    return len(json.dumps(value))


def _around(node: _Closed | _Sums, own: list, rich: tuple | None, below: list) -> None:
    """The best node of each field and the richest array of a container, from its own and its children's.

    ``best`` holds (priority, depth, value), ``rich`` (size, depth, array). What stands in the container
    itself goes before what is deeper, and of its children the last go first, as a stack of pending
    values meets them; only a better one replaces what is there.
    """
    best = own
    for child in reversed(below):
        for field, found in enumerate(child.best):
            if found is not None:
                here = best[field]
                if here is None or found[0] < here[0] or found[0] == here[0] and found[1] + 1 < here[1]:
                    best[field] = (found[0], found[1] + 1, found[2])
        if child.rich is not None and (rich is None or child.rich[0] > rich[0]):
            rich = (child.rich[0], child.rich[1] + 1, child.rich[2])
    node.best, node.rich = best, rich


def _array(values: list) -> _Sums:
    """An array and the arrays in it, the inner ones first."""
    nested = [values]
    for array in nested:
        nested.extend(v for v in array if type(v) is list)
    done: dict[int, _Sums] = {}
    for array in reversed(nested):
        sums = done[id(array)] = _Sums()
        size, objects, below = 2 + 2 * max(len(array) - 1, 0), 0, []
        for value in array:
            kind = type(value)
            if kind is _Closed:
                objects += value.size
                below.append(value)
            elif kind is list:
                below.append(done[id(value)])
                size += below[-1].size
            else:
                size += _scalar_size(value)
        sums.size = size + objects
        _around(sums, [None] * len(_PREFER), (objects, 0, array) if objects else None, below)
    return done[id(values)]


@lru_cache(4096)
def _named(key: str) -> tuple[int, Sequence[tuple[int, int]]]:
    """A key's serialised size with its colon, and the fields it can name; documents use the same few keys."""
    return len(encode_basestring_ascii(key)) + 2, _NAMES.get(key.lower(), ())


def _object(pairs: list[tuple[str, object]]) -> _Closed:
    """The parser calls this at the end of every object."""
    closed = _Closed(pairs)
    size, own, below = 2 + 2 * max(len(closed) - 1, 0), [None] * len(_PREFER), []
    for key, value in closed.items():
        kind = type(value)
        length, fields = _named(key)
        size += length
        if kind is str:
            size += len(encode_basestring_ascii(value))
        elif kind is _Closed:
            size += value.size
            below.append(value)
        elif kind is list:
            sums = _array(value)
            size += sums.size
            below.append(sums)
        else:
            size += _scalar_size(value)
        for field, priority in fields:
            if own[field] is None or priority < own[field][0]:
                own[field] = (priority, 0, value)
    closed.size = size
    _around(closed, own, None, below)
    return closed


def _richest(text: str | None) -> tuple | None:
    """(size, depth, array) of a document's richest array, in one pass over its text."""
    try:
        root = json.loads(text, object_pairs_hook=_object)
    except (ValueError, TypeError, RecursionError):
        return None
    if type(root) is list:
        root = _array(root)
    return root.rich if type(root) in (_Closed, _Sums) else None


def _useful(value: object) -> bool:
    return type(value) in (int, float, bool) or type(value) is str and bool(value.strip())


def _dug(value: object, prefer: tuple[str, ...]) -> object:
    """A useful scalar: the value itself, or the first one below it, preferred names before others."""
    pending = [value]
    while pending:
        value = pending.pop()
        if _useful(value):
            return value
        if type(value) is _Closed:
            for name in prefer:
                if _useful(value.get(name)):
                    return value[name]
            pending.extend(reversed(value.values()))
        elif type(value) is list:
            pending.extend(reversed(value))
    return None


def _text(value: object) -> str | None:
    if value is None or type(value) in (list, _Closed):
        return None
    return value if type(value) is str else json.dumps(value)


def _cells(value: object, prefer: tuple[str, ...]) -> tuple:
    """Type and scalar of a node, then scalar and type of what is dug out of it."""
    kind = type(value)
    if kind is str:
        return ("string", value, value, "string") if value.strip() else ("string", value, None, None)
    if kind in (int, float, bool):
        name, text = _TYPES[kind], json.dumps(value)
        return name, text, text, name
    dug = _dug(value, prefer)
    return _type(value), _text(value), _text(dug), None if dug is None else _type(dug)


def _type(value: object) -> str:
    return _TYPES.get(type(value), "object")


def _scores(batch: pa.RecordBatch, doc: str, body: str) -> pa.RecordBatch:
    """(doc, array_depth, score) of a batch's documents; one parsed document is held at a time."""
    keep, depths, scores = [], [], []
    for row, text in enumerate(batch.column(body)):
        found = _richest(text.as_py())
        if found is not None:
            keep.append(row)
            depths.append(found[1])
            scores.append(found[0])
    return pa.RecordBatch.from_arrays(
        [batch.column(doc).take(pa.array(keep, pa.int64())), pa.array(depths, pa.int32()), pa.array(scores, pa.int64())],
        names=[doc, "array_depth", "score"])


def richest_array(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Per document the array whose objects serialise to the most text: rows ``(doc, array_depth, score)``.

    Among equals the one met first from the end of the document wins. Documents without such an array
    have no row.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scores(batch, doc, body)

    return docs.select(doc, body).mapInArrow(rows, T.StructType([docs.schema[doc], T.StructField("array_depth", T.IntegerType()), T.StructField("score", T.LongType())]))


def record_values(docs: DataFrame, doc: str = "doc", body: str = "body", limit: int | None = None) -> DataFrame:
    """One row per object of each document's richest array and, for every field, four columns.

    ``<field>_node_type`` and ``<field>_node`` are the type and scalar of the node that names the field
    (by name priority, then depth, then the last branch first), ``<field>`` and ``<field>_type`` the
    scalar that is dug out of it. One pass of the parser over the text finds both the array and the nodes.
    """
    parts = [f"{field}{end}" for field in fixed.RECORD_FIELDS for end in ("_node_type", "_node", "", "_type")]
    schema = T.StructType([docs.schema[doc], T.StructField("record", T.IntegerType()), *[T.StructField(p, T.StringType()) for p in parts]])

    def packed(batch: pa.RecordBatch, at: list[int], records: list[int], values: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*values)] if values else [pa.array([], pa.string()) for _ in parts]
        return pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array(at, pa.int64())), pa.array(records, pa.int32()), *columns], names=[doc, "record", *parts])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, records, values = [], [], []
            for row, text in enumerate(batch.column(body).to_pylist()):
                found = _richest(text)
                items = [v for v in found[2] if type(v) is _Closed] if found else []
                for record, item in enumerate(items[:limit]):
                    line = []
                    for best, prefer in zip(item.best, _PREFER):
                        line += _NO_CELLS if best is None else _cells(best[2], prefer)
                    at.append(row)
                    records.append(record)
                    values.append(line)
                    if len(at) == CHUNK:
                        yield packed(batch, at, records, values)
                        at, records, values = [], [], []
            yield packed(batch, at, records, values)

    return docs.select(doc, body).mapInArrow(rows, schema)


def best_fields(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """The chosen node per record and field: (doc, record, field, node_type, node_scalar)."""
    found = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(f"{field}_node_type").alias("type"), F.col(f"{field}_node").alias("scalar"))
        for field in fixed.RECORD_FIELDS
    ])
    listed = record_values(docs, doc, body).select(doc, "record", F.explode(found).alias("f"))
    return listed.filter("f.type IS NOT NULL").select(
        doc, "record", "f.field", F.col("f.type").alias("node_type"), F.col("f.scalar").alias("node_scalar"))


def flatten_records(docs: DataFrame, doc: str = "doc", body: str = "body", limit: int | None = None) -> DataFrame:
    """Records (title, price, url, id and the types of the mixed ones) of each JSON document.

    All of a document's records, or the first ``limit``. Nothing is shuffled.
    """
    values = record_values(docs, doc, body, limit).filter(F.coalesce(*fixed.RECORD_FIELDS).isNotNull())
    link = F.when(F.col("url_type") == "boolean", F.initcap("url")).otherwise(F.col("url"))
    return values.select(doc, "record", "title", "price", "price_type", cut_fragment(link).alias("url"), "id", "id_type")


def capture_records(
    endpoints: DataFrame, n: int | None = None, listed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(records of the top-scored response per page, summary per page).

    The summary counts the ranked responses (the top ``n`` if it is given) and lists their URLs (the
    first ``listed``); a page whose
    capture holds no data response gets an error.
    """
    ranked = cut_lineage(rank_endpoints(score_endpoints(endpoints), n))
    top = ranked.filter((F.col("rank") == 1) & F.col("is_json"))
    records = flatten_records(top.select(F.col("page_url").alias("doc"), "body")).withColumnRenamed(
        "doc", "page_url"
    )
    listing = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "url") if listed is None else F.when(F.col("rank") <= listed, F.struct("rank", "url")))),
        lambda e: e["url"],
    )
    summary = ranked.groupBy("page_url").agg(
        F.count("*").alias("api_endpoints"), listing.alias("api_urls")
    )
    return records, summary


def capture_status(jobs: DataFrame, summary: DataFrame) -> DataFrame:
    """Capture jobs (job_id, page_url) with their summary; none captured is an error."""
    joined = jobs.join(summary, "page_url", "left")
    empty = F.col("api_endpoints").isNull()
    return joined.select(
        "job_id", "page_url", F.coalesce("api_endpoints", F.lit(0)).alias("api_endpoints"), "api_urls",
        F.when(empty, fixed.STATUS_ERROR).otherwise(fixed.STATUS_OK).alias("status"),
        F.when(empty, NO_DATA_ERROR).alias("error"),
    )
