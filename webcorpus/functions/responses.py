"""Response classification: challenges, blocks and login walls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions.text import strip
from webcorpus.functions.urls import _col


def detect_captcha(text: Column | str) -> Column:
    """Vendor of the challenge found in a body (the whole body is searched), or NULL."""
    return F.coalesce(
        *[F.when(_col(text).rlike(p), F.lit(vendor)) for vendor, p in fixed.CAPTCHA_MARKS]
    )


def header_block(headers: Column | str) -> Column:
    """Vendor that the response headers (a map) give away, or NULL."""
    names = F.transform(F.map_keys(_col(headers)), lambda k: F.lower(k))
    rules = []
    for key, vendor in fixed.WAF_HEADERS:
        if key.endswith("-"):
            hit = F.array_join(names, "\n").rlike(rf"(?m)^{key}")
        else:
            hit = F.array_contains(names, key)
        rules.append(F.when(hit, F.lit(vendor)))
    return F.coalesce(*rules)


def classify_response(
    status: Column | str, headers: Column | str | None, text: Column | str, min_len: int = 0
) -> Column:
    """``struct(class, signal)``; a challenge beats everything, even status 200."""
    code = _col(status)
    vendor = detect_captcha(text)
    waf = header_block(headers) if headers is not None else F.lit(None).cast("string")

    def verdict(name: str, signal: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), signal.alias("signal"))

    empty_body = (
        (code == 200) & (F.length(strip(F.coalesce(_col(text), F.lit("")))) < min_len)
        if min_len
        else F.lit(False)
    )
    return (
        F.when(vendor.isNotNull(), verdict("captcha", vendor))
        .when(waf.isNotNull(), verdict("blocked", F.concat(F.lit("waf:"), waf)))
        .when(
            code.isin(*fixed.BLOCK_STATUSES),
            verdict("blocked", F.concat(F.lit("status:"), code.cast("string"))),
        )
        .when(empty_body, verdict("blocked", F.lit("empty_body")))
        .otherwise(verdict("ok", F.lit("")))
    )


def _contains_any(message: Column | str, needles: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(_col(message), F.lit("")))
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: low.contains(n))


def media_auth_wall(message: Column | str) -> Column:
    return _contains_any(message, fixed.MEDIA_LOGIN_MARKS)


def comment_auth_wall(message: Column | str) -> Column:
    return _contains_any(message, fixed.COMMENT_LOGIN_MARKS)


def start_tier(hint: Column | str, cached: Column | str, cap: Column | int) -> Column:
    """First fetch tier to try: the higher of hint and cached winner, at most ``cap``."""
    top = cap if isinstance(cap, Column) else F.lit(cap)
    return F.least(
        F.greatest(F.coalesce(_col(hint), F.lit(0)), F.coalesce(_col(cached), F.lit(0))), top
    )
