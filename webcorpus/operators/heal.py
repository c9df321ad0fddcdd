"""Field extraction that survives changed markup."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webcorpus import fixed
from webcorpus.operators.elements import HEAD_CHARS, Element, Tree
from webcorpus.operators.selectors import first_match, place

BROADCAST_FIELDS = 10_000
FINGERPRINT = "struct<tag:string,el_id:string,classes:array<string>,text:string,attrs:map<string,string>>"
_SIGN = re.compile(r"\S")


class _Page:
    """A parsed page: its elements in order and, on demand, the beginning or all of their text."""

    def __init__(self, html: str | None):
        tree = Tree(None, runs=False).read(html)
        self.elements = tree.rows
        self.text = "".join(tree.text)
        self._placed = None

    @property
    def placed(self) -> list:
        if self._placed is None:
            self._placed = place(self.elements)
        return self._placed

    def head(self, element: Element) -> str:
        """The first characters of the trimmed text; long texts are not copied."""
        begin = _SIGN.search(self.text, element.start, element.end)
        if begin is None:
            return ""
        stop = begin.start() + HEAD_CHARS
        head = self.text[begin.start():min(stop, element.end)]
        return head if head[-1:].strip() or stop < element.end and _SIGN.search(self.text, stop, element.end) else head.rstrip()

    def whole(self, element: Element) -> str:
        return self.text[element.start:element.end].strip()

    def fingerprint(self, element: Element) -> dict:
        return {
            "tag": element.tag, "el_id": element.el_id, "classes": element.classes, "text": self.head(element),
            "attrs": [(k, v) for k, v in element.attrs.items() if k != "class"],
        }

    def similarity(self, saved: dict, element: Element) -> float:
        """How alike an element and a saved fingerprint are, from 0 to 1."""
        weights, score = fixed.HEAL_WEIGHTS, 0.0
        if element.tag == saved["tag"]:
            score += weights["tag"]
        if saved["el_id"] and element.el_id == saved["el_id"]:
            score += weights["el_id"]
        mine, its = set(element.classes), set(saved["classes"] or ())
        if mine or its:
            score += weights["classes"] * (len(mine & its) / len(mine | its))
        if saved["text"]:
            head = self.head(element)
            same = next((k for k, (a, b) in enumerate(zip(head, saved["text"])) if a != b), min(len(head), len(saved["text"])))
            score += weights["text"] * (same / len(saved["text"]))
        return score

    def nearest(self, saved: dict) -> tuple[float, Element | None]:
        """The most similar element, the first of equals."""
        best, found = -1.0, None
        for element in self.elements:
            score = self.similarity(saved, element)
            if score > best:
                best, found = score, element
        return max(best, 0.0), found


def _suggested(element: Element) -> str:
    if element.el_id:
        return f"#{element.el_id}"
    return ".".join([element.tag, *element.classes])


def _field(page: _Page, wanted: dict, min_score: float) -> tuple:
    """(field, value, healed, selector, score, fp) of one field on one page."""
    field, selector, saved = wanted["field"], wanted["selector"], wanted["fp"]
    element = first_match(selector or "", page.placed)
    if element is not None:
        return field, page.whole(element), False, selector, 1.0, page.fingerprint(element)
    if saved is None:
        return field, None, False, selector, 0.0, None
    saved = {**saved, "tag": saved["tag"] or "", "el_id": saved["el_id"] or "", "text": saved["text"] or ""}
    score, element = page.nearest(saved)
    if element is None or score < min_score:
        return field, None, False, selector, score, None
    return field, page.whole(element), True, _suggested(element), score, page.fingerprint(element)


def heal_fields(
    pages: DataFrame, fields: DataFrame, fingerprints: DataFrame,
    key: str = "page_id", min_score: float = fixed.HEAL_MIN_SCORE,
) -> DataFrame:
    """Value of each field on each page: by selector, else by the saved fingerprint.

    ``pages`` holds (key, profile, html), ``fields`` (profile, field, selector) and
    ``fingerprints`` (profile, field, fp), as saved before this batch. The returned
    ``fp`` is what to save afterwards. A page meets the fields of its profile in its own row, is parsed
    once, and only the values leave it: elements are compared by the beginning of their text, and the
    whole text is read for the chosen one alone. A null page has no elements; a profile without fields
    gives no rows.
    """
    wanted = fields.join(fingerprints, ["profile", "field"], "left")
    by_profile = wanted.groupBy("profile").agg(F.collect_list(F.struct("field", "selector", "fp")).alias("_wanted"))
    if wanted.count() <= BROADCAST_FIELDS:
        by_profile = F.broadcast(by_profile)  # never the pages
    schema = T.StructType([
        pages.schema[key], pages.schema["profile"], T.StructField("field", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("healed", T.BooleanType()), T.StructField("selector", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("fp", fingerprints.schema["fp"].dataType),
    ])
    kinds = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, at = [], []
                for row, (html, asked) in enumerate(zip(part.column("html"), part.column("_wanted").to_pylist())):
                    page = _Page(html.as_py())
                    for field in asked:
                        if field["fp"] is not None:
                            field["fp"] = {**field["fp"], "attrs": dict(field["fp"]["attrs"] or ())}
                        rows.append(_field(page, field, min_score))
                        at.append(row)
                take = pa.array(at, pa.int32())
                columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]
                made = [pa.array(c, f.type) for c, f in zip(columns, list(kinds)[2:])]
                yield pa.RecordBatch.from_arrays([part.column(key).take(take), part.column("profile").take(take), *made], names=kinds.names)

    return pages.select(key, "profile", "html").join(by_profile, "profile").mapInArrow(read, schema)
