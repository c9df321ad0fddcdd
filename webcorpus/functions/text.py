"""Markdown and text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions.urls import _col, let

# Unicode white space and line ends, spelled out because Java's \s is ASCII only.
SPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"
_LINE_CHARS = r"\n\r\x0B\f\x1c-\x1e\x85  "
MARKDOWN_LINK = r"\[[^\]]*\]\([^)]*\)"


def strip(text: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    left = F.regexp_replace(_col(text), rf"^[{SPACE}]+", "")
    return F.regexp_replace(left, rf"(?<![{SPACE}])[{SPACE}]+$|^[{SPACE}]+$", "")


def lines(text: Column | str) -> Column:
    return F.split(_col(text), LINE_END, -1)


def title_from_markdown(md: Column | str) -> Column:
    """The heading on the first non-blank line, or NULL."""
    first = F.regexp_extract(_col(md), rf"^[{SPACE}]*([^{_LINE_CHARS}]*)", 1)
    title = strip(F.regexp_replace(first, r"^#+", ""))
    return F.when(first.startswith("#") & (title != ""), title)


def heading_title(text: Column | str) -> Column:
    """First heading anywhere in the text, at most 90 characters; NULL without one."""
    found = F.filter(
        F.transform(lines(text), lambda line: strip(line)), lambda line: line.startswith("#")
    )
    title = strip(F.regexp_replace(F.get(found, 0), r"^[# ]+", ""))
    # Most texts have no mark at all and are not taken apart.
    return F.when(_col(text).contains("#"), let(title, lambda t: F.when(t != "", F.substring(t, 1, 90))))


def prose_score(md: Column | str) -> Column:
    """Characters on lines that read like prose: long or headings, and not mostly links."""

    def line_score(total: Column, line: Column) -> Column:
        size = F.length(line)
        link_chars = F.when(
            line.contains("]("), size - F.length(F.regexp_replace(line, MARKDOWN_LINK, ""))
        ).otherwise(F.lit(0))
        counted = ((size >= 40) | line.startswith("#")) & (link_chars <= size * F.lit(0.4))
        return total + F.when(counted, size).otherwise(F.lit(0)).cast("bigint")

    stripped = F.transform(lines(F.coalesce(_col(md), F.lit(""))), lambda line: strip(line))
    return F.aggregate(stripped, F.lit(0).cast("bigint"), line_score)


def llms_txt(
    body: Column | str, title: Column | str, source_url: Column | str
) -> Column:
    """Body under a title line and a source line."""
    name = strip(title)
    head = F.concat(
        F.lit("# "),
        F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.lit(fixed.LLMS_DEFAULT_TITLE)),
    )
    source = F.when(
        F.coalesce(_col(source_url), F.lit("")) != "",
        F.concat(F.lit(f"\n\n> {fixed.LLMS_SOURCE_LABEL}: "), _col(source_url)),
    ).otherwise(F.lit(""))
    return F.concat(
        head, source, F.lit("\n\n"), strip(F.coalesce(_col(body), F.lit(""))), F.lit("\n")
    )


def bundle_section(url: Column | str, md: Column | str) -> Column:
    return F.concat(
        F.lit("## "), _col(url), F.lit("\n\n"), strip(F.coalesce(_col(md), F.lit("")))
    )


_NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def unescape_entities(text: Column | str) -> Column:
    """Decode character references; text without ``&`` passes through untouched.

    Numeric references and the HTML 4 named set (taken from the standard library's
    table) are decoded in one left-to-right pass, so ``&amp;lt;`` stays ``&lt;``.
    """
    from html.entities import name2codepoint

    named = {**{name: chr(code) for name, code in name2codepoint.items()}, **_NAMED_ENTITIES}
    table = F.create_map(*[F.lit(x) for pair in sorted(named.items()) for x in pair])
    source = _col(text)
    reference = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"

    def decode(ref: Column) -> Column:
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        number = F.when(
            body.startswith("#x") | body.startswith("#X"),
            F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int"),
        ).otherwise(F.substring(body, F.lit(2), F.length(body)).try_cast("int"))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(
            body.startswith("#"), F.when(valid, char).otherwise(F.lit("�"))
        ).otherwise(F.coalesce(F.try_element_at(table, body), ref))

    refs = F.transform(F.regexp_extract_all(source, F.lit(reference), 0), decode)
    gaps = F.split(source, reference, -1)
    woven = F.array_join(
        F.zip_with(gaps, F.concat(refs, F.array(F.lit(""))), lambda gap, ch: F.concat(gap, ch)), ""
    )
    return F.when(source.contains("&"), woven).otherwise(source)


def strip_tags(html: Column | str) -> Column:
    return strip(F.regexp_replace(_col(html), r"<[^>]+>", ""))


__all__ = [
    "bundle_section", "heading_title", "let", "lines", "llms_txt", "prose_score", "strip",
    "strip_tags", "title_from_markdown", "unescape_entities",
]
