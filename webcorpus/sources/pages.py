"""Page sources and body decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions.urls import _col

PAGE_SCHEMA = (
    "page_id bigint, url string, status_code int, content_type string, text string, "
    "content binary, headers map<string,string>, tier int, proxy string"
)
_UTF8 = ("", "utf-8", "utf8")
_LATIN = ("iso-8859-1", "latin-1", "latin1")
_ASCII = ("us-ascii", "ascii")


def read_pages(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Stored pages: parquet, JSON lines, or raw bodies as files (``binaryFile``)."""
    if format == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        return files.select(F.col("path").alias("url"), "content", F.col("length").alias("bytes"))
    reader = spark.read.format(format)
    if format == "json":
        reader = reader.schema(schema or PAGE_SCHEMA)
    elif schema:
        reader = reader.schema(schema)
    return reader.load(path)


def one_capture(pages: DataFrame, order: str | None = None, url: str = "url", body: str = "html") -> DataFrame:
    """One row per URL: the last by ``order`` (a column, such as the fetch time), equal ones by digest.

    Only URL, order and digest are grouped; the rows come back through a semi join.
    """
    marked = pages.withColumn("_digest", F.xxhash64(body)).withColumn("_order", F.col(order) if order else F.lit(0))
    last = marked.groupBy(url).agg(F.max(F.struct("_order", "_digest")).alias("_last")).select(url, "_last.*")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (url, "_order", "_digest")]
    kept = marked.alias("p").join(last.alias("l"), same, "left_semi").drop("_order", "_digest")
    return kept.dropDuplicates([url])  # the same capture stored twice


def charset_of(content_type: Column | str) -> Column:
    """Charset named by a Content-Type header, lower-cased; empty when it names none."""
    return F.lower(
        F.regexp_extract(F.coalesce(_col(content_type), F.lit("")), r"(?i)charset=[\"']?([\w.:\-]+)", 1)
    )


def within_cap(pages: DataFrame, max_bytes: int, content: str = "content") -> DataFrame:
    """Bodies over the byte limit are not pages."""
    return pages.filter(F.octet_length(content) <= max_bytes)


def decode_utf8(content: Column | str) -> Column:
    return F.make_valid_utf8(_col(content).cast("string"))


def _decode_with_codec(pages: DataFrame, content: str, charset: str) -> DataFrame:
    rest = [f for f in pages.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(body: bytes, name: str) -> str:
            try:
                return bytes(body).decode(name, errors="replace")
            except LookupError:
                return bytes(body).decode("utf-8", errors="replace")

        for batch in batches:
            yield batch.assign(text=[text(b, c) for b, c in zip(batch[content], batch[charset])])

    return pages.mapInPandas(run, schema)


def decode_body(
    pages: DataFrame, content: str = "content", content_type: str = "content_type",
    max_bytes: int | None = None,
) -> DataFrame:
    """Add ``text``: by the header's charset, else as UTF-8; bad bytes become U+FFFD.

    With ``max_bytes`` larger bodies are left out.

    UTF-8, Latin-1 and ASCII, nearly all of the web, stay in the JVM. Pages in another
    charset go through Python's codecs in Arrow batches.
    """
    stored = pages.drop("text")
    if max_bytes is not None:
        stored = within_cap(stored, max_bytes, content)
    named = stored.withColumn("_charset", charset_of(content_type))
    native = F.col("_charset").isin(*_UTF8, *_LATIN, *_ASCII)
    latin = F.decode(F.col(content), "ISO-8859-1")
    text = (
        F.when(F.col("_charset").isin(*_LATIN), latin)
        .when(F.col("_charset").isin(*_ASCII), F.regexp_replace(latin, r"[\x80-\xff]", "�"))
        .otherwise(decode_utf8(content))
    )
    fast = named.filter(native).withColumn("text", text)
    slow = _decode_with_codec(named.filter(~native), content, "_charset")
    return fast.unionByName(slow).drop("_charset")
