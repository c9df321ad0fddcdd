"""Rule-based personal-data detection and masking as row-local expressions.

Everything happens inside one row: no shuffle, whatever the size or skew of the corpus.
Offsets count characters. Patterns spell out Unicode classes, because word boundaries
differ between Java releases.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus import fixed
from webcorpus.functions.rows import settle
from webcorpus.functions.text import SPACE
from webcorpus.functions.urls import _col, let

_W = r"\p{L}\p{N}_"
_D = r"\p{Nd}"
_EDGE = rf"(?:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"
_OCTET = rf"(?:25[0-5]|2[0-4]{_D}|1?{_D}?{_D})"
PATTERNS = {
    "EMAIL": rf"{_EDGE}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}(?![{_W}])",
    "IP": rf"(?<![{_W}])(?:{_OCTET}\.){{3}}{_OCTET}(?![{_W}])",
    "CUIT": rf"(?<![{_W}])(?:20|23|24|27|30|33|34)[-{SPACE}]?{_D}{{8}}[-{SPACE}]?{_D}(?![{_W}])",
    "TARJETA": rf"(?<![{_W}])(?:{_D}[ \-]?){{13,19}}{_EDGE}",
    "TEL": (
        rf"(?<![{_W}.])(?:\+{_D}{{1,3}}[{SPACE}\-]?)?(?:\(?{_D}{{2,4}}\)?[{SPACE}\-]){{1,3}}"
        rf"{_D}{{3,4}}(?![{_W}])"
    ),
}
# A cheap test each pattern implies, so most rows never reach the full pattern.
_HINTS = {
    "EMAIL": lambda text: text.contains("@"),
    "IP": lambda text: text.rlike(rf"{_D}\.{_D}"),
    "CUIT": lambda text: text.rlike(rf"{_D}{{8}}"),
    "TARJETA": lambda text: text.rlike(rf"{_D}[ \-]?{_D}[ \-]?{_D}[ \-]?{_D}[ \-]?{_D}"),
    "TEL": lambda text: text.rlike(rf"{_D}\)?[{SPACE}\-]\(?{_D}"),
}
SPAN_TYPE = "array<struct<start:int,end:int,seq:int,type:string>>"
BLOCK = 256
DENSE = 2  # from so many spans on a text is masked in one walk over it, not by array functions


def _digits(fragment: Column) -> Column:
    return F.regexp_replace(fragment, r"\P{Nd}", "")


def luhn_ok(digits: Column | str) -> Column:
    """Luhn check of a run of 13 to 19 digits."""
    text = _col(digits)
    reversed_digits = F.transform(
        F.split(F.reverse(text), ""), lambda ch: F.ascii(ch) - F.lit(48)
    )
    weighted = F.transform(
        reversed_digits,
        lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2),
    )
    total = F.aggregate(weighted, F.lit(0), lambda acc, d: acc + d)
    return F.when(F.length(text).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def phone_ok(fragment: Column | str) -> Column:
    return F.length(_digits(_col(fragment))).between(8, 15)


def _running(lengths: Column) -> Column:
    """What stands before each element of an integer array, summed; block by block, so that no long array is
    copied for each element."""
    none = F.array().cast("array<int>")

    def sums(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )

    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: sums(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    whole = let(blocks, lambda parts: F.flatten(F.zip_with(
        parts, sums(F.transform(parts, lambda p: p["at"]))["out"], lambda p, before: F.transform(p["out"], lambda at: at + before))))
    return F.when(F.size(lengths) <= BLOCK, sums(lengths)["out"]).when(F.size(lengths) > 0, whole).otherwise(none)


def _spans_of(text: Column, kind: str, seq: int) -> Column:
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    # Between two neighbours of the split lies exactly one match.
    pairs = F.filter(
        F.zip_with(F.split(text, pattern, -1), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))),
        lambda p: p["match"].isNotNull(),
    )
    good = {
        "TARJETA": lambda p: luhn_ok(_digits(p["match"])), "TEL": lambda p: phone_ok(p["match"]),
    }.get(kind, lambda p: F.lit(True))

    def placed(found: Column) -> Column:
        before = _running(F.transform(found, lambda p: p["gap"] + F.length(p["match"])))
        spans = F.zip_with(found, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["match"])).alias("end"), F.lit(seq).alias("seq"),
            F.lit(kind).alias("type"), good(p).alias("good"),
        ))
        return F.transform(F.filter(spans, lambda s: s["good"]), lambda s: F.struct(s["start"], s["end"], s["seq"], s["type"]))

    return F.when(_HINTS[kind](text) & text.rlike(pattern), let(pairs, placed).cast(SPAN_TYPE))


def rule_spans(text: Column | str, kinds: tuple[str, ...] = fixed.PII_TYPES) -> Column:
    """All rule matches of one text as an array of (start, end, seq, type), unmerged."""
    found = [
        F.coalesce(_spans_of(_col(text), kind, seq), F.array().cast(SPAN_TYPE))
        for seq, kind in enumerate(fixed.PII_TYPES, start=1)
        if kind in kinds
    ]
    return F.concat(*found)


def merge_span_array(spans: Column) -> Column:
    """Union of overlapping spans; the first span's type stays and touching spans stay apart."""
    def step(acc: Column, span: Column) -> Column:
        last = F.element_at(acc, -1)
        overlaps = (F.size(acc) > 0) & (span["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
            last["seq"].alias("seq"), last["type"].alias("type"),
        )
        return F.when(
            overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(span)))

    # The struct's field order (start, end, seq, type) is the sort order.
    return F.when(F.size(spans) < 2, spans).otherwise(
        F.aggregate(F.array_sort(spans), F.array().cast(SPAN_TYPE), step)
    )


TOKEN_TYPE = "array<struct<token:string,value:string,type:string>>"


def _masked(text: str, spans: Iterable[tuple]) -> tuple[str, dict[str, tuple[str, str]]]:
    """Masked text and (token, type) per value in one walk: spans by start, those that overlap as one, values numbered as they come."""
    out: list[str] = []
    tokens: dict[str, tuple[str, str]] = {}
    numbers: dict[str, int] = {}
    at, pending = 0, None

    def put() -> int:
        start, end, kind = pending
        value = text[start:end]
        if value not in tokens:
            numbers[kind] = numbers.get(kind, 0) + 1
            tokens[value] = (f"{fixed.TOKEN_OPEN}{kind}_{numbers[kind]}{fixed.TOKEN_CLOSE}", kind)
        out.extend((text[at:start], tokens[value][0]))
        return end

    for start, end, _, kind in sorted(spans):
        if pending is not None and start < pending[1]:
            pending = (pending[0], max(pending[1], end), pending[2])
            continue
        if pending is not None:
            at = put()
        pending = (start, end, kind)
    if pending is not None:
        at = put()
    return "".join([*out, text[at:]]), tokens


_TOKEN = T.StructType([T.StructField(name, T.StringType()) for name in ("token", "value", "type")])


@F.arrow_udf(T.StructType([T.StructField("masked", T.StringType()), T.StructField("tokens", T.ArrayType(_TOKEN))]))
def _mask_dense(texts: pa.Array, spans: pa.Array) -> pa.Array:
    # Spans come and tokens go as flat columns: an object per span would cost more than the walk.
    places = [pc.struct_field(spans.values, name).to_pylist() for name in ("start", "end", "seq", "type")]
    at = spans.offsets.to_pylist()
    masked, ends, found = [], [0], ([], [], [])
    for text, begin, end in zip(texts.to_pylist(), at, at[1:]):
        done, tokens = (None, {}) if text is None else _masked(text, zip(*[p[begin:end] for p in places]))
        masked.append(done)
        for value, (token, kind) in tokens.items():
            for held, x in zip(found, (token, value, kind)):
                held.append(x)
        ends.append(len(found[0]))
    names = ["token", "value", "type"]
    tokens = pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in found], names)
    return pa.StructArray.from_arrays([pa.array(masked, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)], ["masked", "tokens"])


def mask_text(df: DataFrame, text: str, spans: str, prefix: str = "") -> DataFrame:
    """Replace spans by stable typed tokens, numbered per type and text.

    Adds ``{prefix}masked``, ``{prefix}tokens`` (token, value, type) and
    ``{prefix}entities``. Equal fragments share a token. Each step is its own
    projection, so that no array is computed twice. A text with ``DENSE`` spans or more goes to a
    Python worker, where one walk masks it; no other text does.
    """
    has = F.size("_spans") > 0
    empty_tokens = F.array().cast(TOKEN_TYPE)
    dense = F.size(spans) >= DENSE
    walked = _mask_dense(F.when(dense, F.col(text)), F.when(dense, F.col(spans).cast(SPAN_TYPE)))
    step = df.withColumn("_dense", walked).withColumn("_spans", F.when(F.col("_dense.masked").isNull(), merge_span_array(F.col(spans))))
    step = step.withColumn(
        "_pieces",
        F.when(
            has,
            F.transform(
                "_spans",
                lambda s: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"),
                    F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("value"),
                ),
            ),
        ),
    )

    def number(acc: Column, piece: Column) -> Column:
        known = F.exists(acc, lambda t: t["value"] == piece["value"])
        same_type = F.size(F.filter(acc, lambda t: t["type"] == piece["type"]))
        token = F.concat(
            F.lit(fixed.TOKEN_OPEN), piece["type"], F.lit("_"), (same_type + 1).cast("string"),
            F.lit(fixed.TOKEN_CLOSE),
        )
        fresh = F.struct(token.alias("token"), piece["value"].alias("value"),
                         piece["type"].alias("type"))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(fresh)))

    step = step.withColumn(
        f"{prefix}tokens",
        F.when(has, F.aggregate("_pieces", empty_tokens, number)).otherwise(F.coalesce("_dense.tokens", empty_tokens)),
    )
    step = step.withColumn(
        "_lookup",
        F.when(
            has,
            F.map_from_entries(
                F.transform(
                    f"{prefix}tokens",
                    lambda t: F.struct(t["value"].alias("key"), t["token"].alias("value")),
                )
            ),
        ),
    )
    gap_starts = F.concat(F.array(F.lit(0)), F.transform("_pieces", lambda p: p["end"]))
    gap_ends = F.concat(
        F.transform("_pieces", lambda p: p["start"]), F.array(F.length(F.col(text)))
    )
    gaps = F.zip_with(
        gap_starts, gap_ends, lambda a, b: F.substring(F.col(text), a + 1, b - a)
    )
    tokens = F.concat(
        F.transform("_pieces", lambda p: F.col("_lookup")[p["value"]]), F.array(F.lit(""))
    )
    woven = F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, t)), "")
    step = step.withColumn(f"{prefix}masked", F.when(has, woven).otherwise(F.coalesce("_dense.masked", text)))
    return settle(
        step.drop("_dense", "_spans", "_pieces", "_lookup"),
        {
            f"{prefix}masked": F.col(f"{prefix}masked"), f"{prefix}tokens": F.col(f"{prefix}tokens"),
            f"{prefix}entities": F.size(f"{prefix}tokens"),
        },
    )


def restore_tokens(content: Column | str, tokens: Column | str) -> Column:
    """Put the values of (token, value) structs back, longest token first."""
    ordered = F.array_sort(
        _col(tokens),
        lambda a, b: (F.length(b["token"]) - F.length(a["token"])).cast("int"),
    )
    return F.aggregate(
        ordered, _col(content), lambda text, t: F.replace(text, t["token"], t["value"])
    )
