"""JSON documents as node tables, and the counts and scores built on them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webcorpus.functions import urls as U

NODE_FIELDS = [
    T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("obj_index", T.IntegerType()), T.StructField("key", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("parent_type", T.StringType()),
    T.StructField("scalar", T.StringType()), T.StructField("json_len", T.LongType()),
    T.StructField("visit", T.IntegerType()), T.StructField("parent_visit", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("obj_path", T.ArrayType(T.IntegerType())),
    T.StructField("ancestors", T.ArrayType(T.IntegerType())),
    T.StructField("pointer", T.StringType()),
]
CHUNK = 4096  # rows handed on at once, and those of one more document


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    if value is None:
        return "null"
    return "string" if isinstance(value, str) else "number"


class Nodes:
    """The nodes of one value in document order, one list per property; the others are built when asked for."""

    def __init__(self, root: object):
        self.parents: list[int] = []
        self.values: list[object] = []
        self.keys: list[str | None] = []
        self.pos: list[int] = []
        self.obj_index: list[int | None] = []
        pending = [(root, -1, None, 0, None)]
        while pending:
            value, parent, key, pos, obj_index = pending.pop()
            node = len(self.values)
            for held, x in ((self.values, value), (self.parents, parent), (self.keys, key), (self.pos, pos), (self.obj_index, obj_index)):
                held.append(x)
            if isinstance(value, (dict, list)):
                pairs = value.items() if isinstance(value, dict) else ((None, v) for v in value)
                below, objects = [], 0
                for index, (name, child) in enumerate(pairs):
                    is_object = isinstance(child, dict)
                    below.append((child, node, name, index, objects if is_object else None))
                    objects += is_object
                pending.extend(reversed(below))

    def _down(self, first: object, step) -> list:
        """A property that each node makes of its parent's."""
        out: list = []
        for node, parent in enumerate(self.parents):
            out.append(first if parent < 0 else step(out[parent], node))
        return out

    def _of_parent(self, values: list) -> list:
        return [None if p < 0 else values[p] for p in self.parents]

    def _sizes(self) -> list[int]:
        sizes = [2 if isinstance(v, (dict, list)) else len(json.dumps(v)) for v in self.values]
        for node in range(len(sizes) - 1, 0, -1):
            # A member adds itself and, unless it is the first, what parts it from the one before.
            key = self.keys[node]
            sizes[self.parents[node]] += sizes[node] + (2 if self.pos[node] else 0) + (0 if key is None else len(json.dumps(key)) + 2)
        return sizes

    def _visits(self) -> list[int]:
        """The order a stack of pending values meets the nodes in: the last branch first."""
        below = [1] * len(self.values)
        for node in range(len(below) - 1, 0, -1):
            below[self.parents[node]] += below[node]
        out, later = [0] * len(below), [1] * len(below)
        for node in range(1, len(below)):
            parent = self.parents[node]
            # All of the parent's nodes but those of this and earlier children come before.
            later[parent] += below[node]
            out[node] = out[parent] + below[parent] - later[parent] + 1
        return out

    def column(self, name: str) -> list:
        return getattr(self, f"_{name}")()

    def _node(self) -> list:
        return list(range(len(self.values)))

    def _parent(self) -> list:
        return [None if p < 0 else p for p in self.parents]

    def _key(self) -> list:
        return self.keys

    def _pos(self) -> list:
        return self.pos

    def _obj_index(self) -> list:
        return self.obj_index

    def _depth(self) -> list:
        return self._down(0, lambda above, _: above + 1)

    def _type(self) -> list:
        return [_kind(v) for v in self.values]

    def _parent_type(self) -> list:
        return self._of_parent(self._type())

    def _scalar(self) -> list:
        return [v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list)) else json.dumps(v) for v in self.values]

    def _json_len(self) -> list:
        return self._sizes()

    def _visit(self) -> list:
        return self._visits()

    def _parent_visit(self) -> list:
        return self._of_parent(self._visits())

    def _path(self) -> list:
        return self._down([], lambda above, node: [*above, self.pos[node]])

    def _obj_path(self) -> list:
        return self._down([], lambda above, node: [*above, self.obj_index[node]])

    def _ancestors(self) -> list:
        return self._down([], lambda above, node: [*above, self.parents[node]])

    def _pointer(self) -> list:
        def step(above: str, node: int) -> str:
            key = self.keys[node]
            return f"{above}/{self.pos[node]}" if key is None else above + "/" + key.replace("~", "~0").replace("/", "~1")

        return self._down("", step)


def parsed(text: str | None) -> Nodes | None:
    """The nodes of a text, or nothing when it is not JSON."""
    try:
        return Nodes(json.loads(text))
    except (ValueError, TypeError, RecursionError):
        return None


def walk_json(text: str, columns: Sequence[str] | None = None) -> list[dict]:
    """Nodes of one document in document order, with the named properties; nothing when it does not parse."""
    nodes = parsed(text)
    names = columns or [f.name for f in NODE_FIELDS]
    return [] if nodes is None else [dict(zip(names, row)) for row in zip(*[nodes.column(n) for n in names])]


def json_nodes(docs: DataFrame, column: str = "body", columns: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Node rows of every parsable document: its other columns and the node columns, in document order.

    ``columns`` names the node columns that are made (all if not given), ``types`` the kinds of nodes that
    get a row. ``visit`` numbers the nodes from the last branch to the first, ``json_len`` is the
    serialised size; ``path`` and ``obj_path`` hold the position among all and among object siblings, from
    the root down, and ``ancestors`` the node numbers above.
    """
    keys = [c for c in docs.columns if c != column]
    fields = [f for f in NODE_FIELDS if columns is None or f.name in columns]
    schema = T.StructType([docs.schema[c] for c in keys] + fields)
    target = to_arrow_schema(T.StructType(fields))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            made: list[list] = [[] for _ in fields]

            def packed() -> pa.RecordBatch:
                take = pa.array(at, pa.int32())
                arrays = [batch.column(k).take(take) for k in keys] + [pa.array(v, f.type) for v, f in zip(made, target)]
                return pa.RecordBatch.from_arrays(arrays, names=[*keys, *target.names])

            for row, text in enumerate(batch.column(column)):
                nodes = parsed(text.as_py())
                if nodes is None:
                    continue
                keep = range(len(nodes.values)) if types is None else [k for k, kind in enumerate(nodes.column("type")) if kind in types]
                at.extend([row] * len(keep))
                for held, field in zip(made, fields):
                    values = nodes.column(field.name)
                    held.extend(values if types is None else [values[k] for k in keep])
                if len(at) > CHUNK:
                    yield packed()
                    at, made = [], [[] for _ in fields]
            yield packed()

    return docs.select(*keys, column).mapInArrow(rows, schema)


def _facts(text: str | None) -> tuple[bool, int]:
    """Whether a text is JSON, and how many list items and object keys it has."""
    try:
        pending = [json.loads(text)]
    except (ValueError, TypeError, RecursionError):
        return False, 0
    items = 0
    while pending:
        value = pending.pop()
        children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
        items += len(children)
        pending.extend(children)
    return True, items


FACTS = T.StructType([T.StructField("is_json", T.BooleanType()), T.StructField("items", T.LongType())])


@F.pandas_udf(FACTS)
def json_facts(texts: pd.Series) -> pd.DataFrame:
    """``is_json`` and ``items`` of each text, by the parser that makes the nodes."""
    return pd.DataFrame([_facts(t) for t in texts], columns=["is_json", "items"])


def count_items(docs: DataFrame, column: str = "body") -> DataFrame:
    """List items and object keys of every parsable document, counted where the document is."""
    keys = [c for c in docs.columns if c != column]
    facts = docs.select(*keys, json_facts(column).alias("_facts"))
    return facts.filter("_facts.is_json").select(*keys, F.col("_facts.items").alias("items"))


def data_score(
    is_data: Column, size: Column, items: Column, url: Column | str, page_url: Column | str
) -> Column:
    """How likely a captured response is the page's data rather than noise."""
    host = F.coalesce(U.url_host(url), F.lit(""))
    target = F.coalesce(U.url_host(page_url), F.lit(""))
    link = U._col(url)
    same_site = U.reg_domain(host) == U.reg_domain(target)
    api = host.startswith("api.") | link.contains("/api/") | link.contains("/rest/")
    score = (
        size + items * 150
        + F.when(same_site, 8000).otherwise(0)
        + F.when(api, 4000).otherwise(0)
    )
    return F.when(is_data, score).otherwise(F.lit(0)).cast("bigint")


def score_endpoints(endpoints: DataFrame) -> DataFrame:
    """Add ``items`` and ``data_score``, each from the row's own body."""
    facts = endpoints.withColumn("_facts", json_facts("body"))
    known = facts.withColumn("is_json", F.col("_facts.is_json")).withColumn("items", F.col("_facts.items"))
    return known.drop("_facts").withColumn(
        "data_score", data_score(F.col("is_json"), F.col("bytes"), F.col("items"), "url", "page_url")
    )


def rank_endpoints(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Responses per page ranked by score, capture order breaking ties; the top ``n`` if it is given."""
    order = Window.partitionBy("page_url").orderBy(F.col("data_score").desc(), F.col("seq"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)
