"""The library for SQL text: temporary SQL functions and table functions.

A SQL function expands into the query that calls it, so no Python runs and Catalyst sees
plain expressions. Bodies share their patterns and tables with the column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _lookup(table: dict[str, str], key: str) -> str:
    return f"try_element_at(map({_quoted(x for pair in table.items() for x in pair)}), {key})"


def _dot(a: str, b: str) -> str:
    products = f"zip_with({a}, {b}, (x, y) -> double(x) * double(y))"
    return f"aggregate({products}, 0D, (s, x) -> s + x)"


_LAST = "substring_index({p}url_path(u), '/', -1)"
_SITE = "substring_index({p}url_host(u), '.', -2)"
_KINDS = {ext: kind for kind, names in fixed.ASSET_EXTENSIONS.items() for ext in names}
_CAPTCHA = " ".join(f"WHEN t RLIKE r'{pattern}' THEN '{vendor}'" for vendor, pattern in fixed.CAPTCHA_MARKS)
# name: (arguments, return type, body); {p} is the name prefix of the functions it calls.
SCALARS = {
    "url_scheme": ("u STRING", "STRING", f"lower(regexp_extract(u, r'{U.SCHEME_PATTERN}', 1))"),
    "url_host": (
        "u STRING", "STRING",
        f"nullif(lower(translate(regexp_extract(u, r'{U.HOST_PATTERN}', 1), '[]', '')), '')",
    ),
    "url_path": ("u STRING", "STRING", f"regexp_extract(u, r'{U.PATH_PATTERN}', 1)"),
    "url_query": ("u STRING", "STRING", rf"regexp_extract(u, r'{U.QUERY_PATTERN}', 1)"),
    "reg_domain": ("h STRING", "STRING", "substring_index(lower(coalesce(h, '')), '.', -2)"),
    "same_domain": ("a STRING, b STRING", "BOOLEAN", "{p}url_host(a) <=> {p}url_host(b)"),
    "is_chrome": ("u STRING", "BOOLEAN", f"{{p}}url_path(u) RLIKE r'{fixed.CHROME_PATTERN}'"),
    "in_scope": (
        "u STRING, prefix STRING", "BOOLEAN",
        "coalesce(prefix = '', true) OR startswith({p}url_path(u), prefix)",
    ),
    "url_ext": (
        "u STRING", "STRING",
        f"CASE WHEN contains({_LAST}, '.') THEN lower(substring_index({_LAST}, '.', -1)) ELSE '' END",
    ),
    "asset_kind": ("e STRING", "STRING", _lookup(_KINDS, "e")),
    "video_provider": ("u STRING", "STRING", _lookup(fixed.VIDEO_HOSTS, _SITE)),
    "gallery_provider": ("u STRING", "STRING", _lookup(fixed.GALLERY_HOSTS, _SITE)),
    "comment_platform": ("u STRING", "STRING", _lookup(fixed.COMMENT_HOSTS, _SITE)),
    "is_telemetry": ("u STRING", "BOOLEAN", f"u RLIKE r'{fixed.TELEMETRY_PATTERN}'"),
    "redact_url": (
        "u STRING", "STRING",
        "CASE WHEN {p}url_scheme(u) = '' THEN u "
        "ELSE concat({p}url_scheme(u), '://', coalesce({p}url_host(u), 'None'), {p}url_path(u)) END",
    ),
    "detect_captcha": ("t STRING", "STRING", f"CASE {_CAPTCHA} END"),
    "phone_ok": (
        "f STRING", "BOOLEAN", r"length(regexp_replace(f, r'\P{{Nd}}', '')) BETWEEN 8 AND 15"
    ),
    "luhn_ok": (
        "d STRING", "BOOLEAN",
        "length(d) BETWEEN 13 AND 19 AND aggregate(transform(transform(split(reverse(d), ''), "
        "ch -> ascii(ch) - 48), (n, i) -> CASE WHEN i % 2 = 0 THEN n WHEN n > 4 THEN n * 2 - 9 ELSE n * 2 END), "
        "0, (s, n) -> s + n) % 10 = 0",
    ),
    "cosine": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
        "coalesce(CASE WHEN size(a) > 0 AND size(a) = size(b) THEN try_divide("
        f"{_dot('a', 'b')}, sqrt({_dot('a', 'a')}) * sqrt({_dot('b', 'b')})) END, 0D)",
    ),
}
# Bodies whose braces belong to a pattern, not to the prefix.
_LITERAL = ("url_scheme", "url_host", "url_path", "url_query", "is_telemetry", "detect_captcha")


def register(spark: SparkSession, prefix: str = "wc_") -> list[str]:
    """Create every function under ``prefix`` and return the scalar names."""
    from webcorpus.operators.elements import page_elements
    from webcorpus.operators.json_nodes import walk_json

    class HtmlElements:
        def eval(self, html: str) -> Iterator[tuple]:
            for el, parent, tag, el_id, text, attrs in page_elements(html, ("el", "parent", "tag", "el_id", "text", "attrs")):
                yield el, parent, tag, el_id, text, dict(attrs)

    class JsonNodes:
        def eval(self, body: str) -> Iterator[tuple]:
            for row in walk_json(body, ("node", "parent", "depth", "key", "type", "scalar")):
                yield tuple(row.values())

    spark.udtf.register(
        f"{prefix}html_elements",
        F.udtf(
            HtmlElements,
            returnType="el int, parent int, tag string, el_id string, text string, attrs map<string,string>",
        ),
    )
    spark.udtf.register(
        f"{prefix}json_nodes",
        F.udtf(
            JsonNodes,
            returnType="node int, parent int, depth int, key string, type string, scalar string",
        ),
    )
    for name, (arguments, returns, body) in SCALARS.items():
        text = body if name in _LITERAL else body.format(p=prefix)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {text}"
        )
    return [prefix + name for name in SCALARS]
