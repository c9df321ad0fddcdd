"""HTML to markdown by text blocks, and the choice among candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import urls as U
from webcorpus.functions.rows import settle
from webcorpus.functions.text import prose_score, strip
from webcorpus.operators.elements import text_blocks

MAX_LINK_SHARE = 0.5


def main_markdown(pages: DataFrame, html: str = "html", max_link_share: float = MAX_LINK_SHARE) -> DataFrame:
    """Markdown of each page's main text.

    Blocks inside navigation, headers, footers, asides and forms go, and so do blocks
    whose characters are mostly links. A page left with nothing falls back to all its
    text; a page without text has no row. Headings and list items keep their markers.
    Every page is worked on in its own row.
    """
    keys = [c for c in pages.columns if c != html]

    def line(block: Column) -> Column:
        tag, text = block["tag"], block["text"]
        level = F.regexp_extract(tag, "^h([1-6])$", 1)
        return (
            F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text))
            .when(tag == "li", F.concat(F.lit("- "), text))
            .when(tag == "blockquote", F.concat(F.lit("> "), text))
            .otherwise(text)
        )

    def main(block: Column) -> Column:
        return ~block["boilerplate"] & (block["link_chars"] <= F.length(block["text"]) * F.lit(max_link_share))

    blocks = settle(text_blocks(pages, html, "_blocks"), {"_chosen": F.filter("_blocks", main)}).filter(F.size("_blocks") > 0)
    shown = F.when(F.size("_chosen") > 0, F.col("_chosen")).otherwise(F.col("_blocks"))
    return blocks.select(*keys, F.array_join(F.transform(shown, line), "\n\n").alias("content_md"))


def pick_best(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """Best-scoring markdown per page; the first engine wins ties.

    ``candidates`` holds (key, engine, engine_rank, md). Blank candidates do not count.
    """
    scored = candidates.filter(strip(F.coalesce("md", F.lit(""))) != "").select(
        key, "engine", "engine_rank", strip("md").alias("md"), prose_score(strip("md")).alias("score")
    )
    best = F.max_by(
        F.struct("engine", "md", "score"), F.struct("score", (-F.col("engine_rank")).alias("r"))
    )
    return scored.groupBy(key).agg(best.alias("best")).select(
        key, "best.engine", "best.md", "best.score"
    )


def convert_documents(
    pages: DataFrame, convert: Callable[[list[bytes], list[str]], list[str]], key: str = "page_id"
) -> DataFrame:
    """Run a caller's converter over (bytes, file name) batches: rows (key, content_md)."""
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = convert(list(batch["content"]), list(batch["filename"]))
            yield pd.DataFrame({key: batch[key], "content_md": texts})

    return pages.select(key, "content", U.filename_from_url("url").alias("filename")).mapInPandas(
        run, f"{key} {key_type}, content_md string"
    )


def to_markdown(
    pages: DataFrame,
    convert: Callable[[list[bytes], list[str]], list[str]] | None = None,
    key: str = "page_id",
) -> DataFrame:
    """Markdown per page by route: document, HTML page or plain text.

    ``pages`` holds (key, url, content_type, text) and, for documents, content bytes.
    Documents need a converter; without one they go by their text like any other page.
    """
    document = U.is_document("content_type", "url") if convert else F.lit(False)
    route = (
        F.when(document, "document")
        .when(U.looks_like_html("content_type", "text"), "html")
        .otherwise("plain")
    )
    routed = pages.withColumn("route", route)
    html = main_markdown(
        routed.filter(F.col("route") == "html").select(key, F.col("text").alias("html"))
    ).withColumn("route", F.lit("html"))
    plain = routed.filter(F.col("route") == "plain").select(
        key, strip("text").alias("content_md"), "route"
    )
    out = html.unionByName(plain)
    if convert:
        converted = convert_documents(routed.filter(F.col("route") == "document"), convert, key)
        out = out.unionByName(converted.withColumn("route", F.lit("document")))
    return out
