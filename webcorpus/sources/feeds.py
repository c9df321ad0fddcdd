"""URLs out of sitemaps and feeds."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webcorpus.operators.elements import arrow_rows


def _tree(text: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError, TypeError):
        return None


def _is_http(url: str) -> bool:
    return url.startswith(("http://", "https://"))


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""


def _locations(text: str) -> list[str]:
    root = _tree(text)
    found = [] if root is None else [e.text.strip() for e in root.iter() if _tag(e) == "loc" and e.text]
    return [url for url in found if _is_http(url)]


def _links(text: str) -> list[str]:
    root = _tree(text)
    found = [] if root is None else [
        (e.text or "").strip() or e.attrib.get("href", "").strip() for e in root.iter() if _tag(e) == "link"
    ]
    return [url for url in found if _is_http(url)]


def _urls(docs: DataFrame, column: str, read) -> DataFrame:
    keys = [c for c in docs.columns if c != column]
    schema = T.StructType(
        [docs.schema[c] for c in keys]
        + [T.StructField("pos", T.IntegerType()), T.StructField("link", T.StringType())]
    )

    def rows(doc: dict) -> Iterator[tuple]:
        for pos, link in enumerate(read(doc[column])):
            yield tuple(doc[k] for k in keys) + (pos, link)

    return docs.select(*keys, column).mapInArrow(arrow_rows(rows, schema), schema)


def sitemap_urls(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Locations of sitemaps and sitemap indexes, any namespace; broken XML has none.

    A strict XML parse decides what is broken, which no pattern can, so each document goes
    through the standard library's parser on its own.
    """
    return _urls(docs, column, _locations)


def feed_urls(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Links of RSS (text) and Atom (href) feeds."""
    return _urls(docs, column, _links)
