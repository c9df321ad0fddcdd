"""Masking, reversible maps and fail-closed outputs."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import pii
from webcorpus.functions.rows import explode_once, settle
from webcorpus.functions.text import strip
from webcorpus.operators.extraction import extract_structured
from webcorpus.operators.policy import reversible_roles
from webcorpus.operators.ranking import sliced_row_number, with_prefix
from webcorpus.session import cut_lineage

MASK_ERROR = "masking failed, no content is returned"
_OFFSETS_PER_SLICE = 8192


def detect_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rule matches as rows (key, start, end, type, seq), not merged."""
    return explode_once(docs, [key], pii.rule_spans(text), None, "s").select(
        key, F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.col("s.type").alias("type"), F.col("s.seq").alias("seq"),
    )


def _external_spans(text: Column, spans: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fixed.PLACEHOLDER_TYPES.items() for x in pair])

    def locate(span: Column) -> Column:
        size = F.length(text)
        quoted = span["text"]
        fits = (
            (span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= size)
            & (
                quoted.isNull()
                | (F.substring(text, span["start"] + 1, span["end"] - span["start"]) == quoted)
            )
        )
        found = F.when(F.coalesce(quoted, F.lit("")) != "", F.instr(text, quoted)).otherwise(0)
        start = F.when(F.coalesce(fits, F.lit(False)), span["start"]).when(found > 0, found - 1)
        end = F.when(F.coalesce(fits, F.lit(False)), span["end"]).when(
            found > 0, found - 1 + F.length(quoted)
        )
        kind = F.coalesce(F.try_element_at(names, F.coalesce(span["placeholder"], F.lit(""))),
                          F.lit(fixed.DEFAULT_PII_TYPE))
        return F.struct(start.alias("start"), end.alias("end"), F.lit(0).alias("seq"), kind.alias("type"))

    located = F.transform(F.array_sort(spans), locate)
    return F.filter(located, lambda s: s["start"].isNotNull()).cast(pii.SPAN_TYPE)


def with_spans(
    docs: DataFrame, external: DataFrame | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Add ``spans``: external detections first, then the rules.

    ``external`` holds (key, seq, start, end, text, placeholder). Its rows are gathered per
    document, and a document is one row anyway, so the text is joined once and never copied.
    """
    rules = pii.rule_spans(text)
    if external is None:
        return docs.withColumn("spans", rules)
    gathered = external.groupBy(key).agg(
        F.collect_list(F.struct("seq", "start", "end", "text", "placeholder")).alias("_external")
    )
    outside = F.coalesce(_external_spans(F.col(text), F.col("_external")), F.array().cast(pii.SPAN_TYPE))
    return (
        docs.join(gathered, key, "left").withColumn("spans", F.concat(outside, rules)).drop("_external")
    )


def locate_external_spans(
    docs: DataFrame, external: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """External detections with sound offsets: as given, else at the quoted text, else dropped."""
    gathered = external.groupBy(key).agg(
        F.collect_list(F.struct("seq", "start", "end", "text", "placeholder")).alias("_external")
    )
    located = explode_once(
        docs.join(gathered, key), [key], _external_spans(F.col(text), F.col("_external")), None, "s"
    )
    return located.select(key, "s.start", "s.end", "s.type")


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Union of overlapping spans per document, first type kept, touching spans kept apart.

    ``spans`` holds (key, start, end, type, seq). A document with very many spans is cut
    into slices of offsets, so no single task has to order all of them.
    """
    sliced = spans.withColumn("_slice", F.floor(F.col("start") / _OFFSETS_PER_SLICE))
    carried = with_prefix(sliced, [key], "_slice", {"_carry": F.max("end")}, {"_carry": "max"})
    order = Window.partitionBy(key, "_slice").orderBy("start", "end", "seq", "type")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("_carry", F.max("end").over(before))
    flagged = carried.withColumn(
        "_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    )
    counted = with_prefix(flagged, [key], "_slice", {"_done": F.sum("_new")}, {"_done": "sum"})
    island = F.coalesce("_done", F.lit(0)) + F.sum("_new").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counted.withColumn("_island", island)
        .groupBy(key, "_island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.min_by("type", F.struct("start", "end", "seq", "type")).alias("type"),
        )
        .drop("_island")
    )


def mask(
    docs: DataFrame, external: DataFrame | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows with ``masked``, ``tokens`` and ``entities`` in place of the text."""
    return pii.mask_text(with_spans(docs, external, key, text), text, "spans").drop(text, "spans")


def entity_counts(masked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct masked values per document and type."""
    tokens = explode_once(masked, [key], F.col("tokens"), None, "t")
    return tokens.groupBy(key, F.col("t.type").alias("type")).agg(F.count("*").alias("entities"))


def mask_reversible(
    docs: DataFrame, secret: str, created_at: datetime, ttl_s: int = 24 * 3600,
    external: DataFrame | None = None, key: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(masked documents, token maps) for documents (key, role, text).

    The reference ``ref`` is a keyed digest of document, role and run, so a re-run task
    yields the same one and nobody without the secret can guess it. A document without
    personal data has no ref and no map. ``secret`` is an AES key of 16, 24 or 32 bytes.
    """
    masked = mask(docs, external, key, text)
    seed = F.concat_ws("|", F.lit(secret), F.col(key).cast("string"), "role", F.lit(created_at.isoformat()))
    ref = F.when(F.size("tokens") > 0, F.sha2(seed, 256))
    # Searched and masked once, for the documents and for their maps; values are only ever stored encrypted.
    locked = F.transform("tokens", lambda t: F.struct(
        t["token"].alias("token"), F.aes_encrypt(t["value"], F.lit(secret)).alias("value_enc")))
    with_ref = cut_lineage(masked.withColumn("ref", ref).withColumn("tokens", locked))
    expires = F.lit(created_at) + F.make_dt_interval(secs=F.lit(ttl_s))
    maps = with_ref.filter(F.col("ref").isNotNull()).select(
        "ref", key, "role", F.explode("tokens").alias("t"), expires.alias("expires_at")
    ).select("ref", key, "role", "t.token", "t.value_enc", "expires_at")
    return with_ref.drop("tokens"), maps


def open_maps(maps: DataFrame, secret: str, by: str = "ref") -> DataFrame:
    """Decrypted token arrays, one row per ``by`` (the tokens of one text)."""
    value = F.aes_decrypt(F.col("value_enc"), F.lit(secret)).cast("string")
    return maps.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("token", value.alias("value")))).alias("tokens"),
        F.first("role").alias("owner"), F.first("expires_at").alias("expires_at"),
    )


def rehydrate(docs: DataFrame, tokens: DataFrame, key: str = "ref", content: str = "content") -> DataFrame:
    """Put original values back, longest token first. ``tokens`` holds (key, tokens)."""
    return (
        docs.join(tokens.select(key, "tokens"), key, "left")
        .withColumn(
            content,
            F.when(F.col("tokens").isNull(), F.col(content)).otherwise(
                pii.restore_tokens(content, "tokens")
            ),
        )
        .drop("tokens")
    )


def revert(
    requests: DataFrame, maps: DataFrame, consumed: DataFrame, secret: str, now: datetime,
    allowed: dict[str, tuple[str, ...]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, refs consumed now) for requests (request_id, asked_at, ref, role, content).

    The role must allow the reversible mode, and such a request does not touch the map.
    The first other request for a live ref consumes it, whether or not it comes from the
    owner: a wrong role spends the map and gets ``wrong_owner``. Later ones get ``gone``.
    """
    may = F.col("role").isin(*reversible_roles(allowed))
    entitled = requests.filter(may)
    live = open_maps(maps.join(consumed.select("ref"), "ref", "left_anti"), secret).filter(
        F.col("expires_at") > F.lit(now)
    )
    first = entitled.groupBy("ref").agg(
        F.min_by("request_id", F.struct("asked_at", "request_id")).alias("first_request")
    ).join(live, "ref")
    judged = requests.join(first, "ref", "left")
    taken = F.col("first_request") == F.col("request_id")
    status = (
        F.when(~may, "role_not_allowed")
        .when(~F.coalesce(taken, F.lit(False)), "gone")
        .when(F.col("owner") != F.col("role"), "wrong_owner")
        .otherwise("ok")
    )
    answers = judged.withColumn("status", status).select(
        "request_id", "ref", "status",
        F.when(F.col("status") == "ok", pii.restore_tokens("content", "tokens")).alias("content"),
    )
    return answers, first.select("ref")


def apply_privacy(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "mode"
) -> DataFrame:
    """Text by mode: raw when direct, else masked; adds ``anonymised`` and ``entities``.

    Direct rows never reach a detector. Rows in reversible mode are masked the same way;
    their maps come from :func:`mask_reversible`.
    """
    direct = docs.filter(F.col(mode) == fixed.MODE_DIRECT).select(
        *docs.columns, F.lit(False).alias("anonymised"), F.lit(0).alias("entities")
    )
    private = mask(docs.filter(F.col(mode) != fixed.MODE_DIRECT), key=key, text=text)
    return direct.unionByName(
        private.withColumnRenamed("masked", text).withColumn("anonymised", F.lit(True)).select(
            *docs.columns, "anonymised", "entities"
        )
    )


LINES_PER_SLICE = 8192
_CARRIED_LINES = 4  # a number that line ends cut apart has at most so many more


def _numbered(rows: DataFrame, job: str, slice_of: Column, order: list[Column]) -> DataFrame:
    """Rows with ``_line``, their place in the job from 0. Jobs are numbered in slices, never as one value."""
    return sliced_row_number(rows, [job], slice_of, order, "_line").withColumn("_line", F.col("_line") - 1)


def _job_tokens(pieces: DataFrame, job: str) -> DataFrame:
    """(job, value, token) of the pieces of personal data of each job (job, _line, start, type, value).

    A value's type is that of its first occurrence, and first occurrences are numbered per type in order.
    """
    first = pieces.groupBy(job, "value").agg(F.min(F.struct("_line", "start", "type")).alias("f")).select(job, "value", "f.*")
    numbered = sliced_row_number(
        first, [job, "type"], F.floor(F.col("_line") / LINES_PER_SLICE), [F.col("_line"), F.col("start")], "n")
    token = F.concat(F.lit(fixed.TOKEN_OPEN), "type", F.lit("_"), F.col("n").cast("string"), F.lit(fixed.TOKEN_CLOSE))
    return numbered.select(job, "value", token.alias("token"))


def _mask_lines(rows: DataFrame, job: str, text: str) -> DataFrame:
    """Rows (job, _line unique in the job, text) with the text masked, tokens numbered over the whole job.

    Lines are searched where they are. Only pieces of personal data move: to their value's number and back
    to their line.
    """
    merged = F.transform(pii.merge_span_array(F.col("_found")), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"),
        F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("value")))
    searched = cut_lineage(settle(rows.withColumn("_found", pii.rule_spans(text)), {"_pieces": merged}).drop("_found"))
    pieces = explode_once(searched, [job, "_line"], F.col("_pieces"), None, "p").select(job, "_line", "p.*")
    answers = pieces.join(_job_tokens(pieces, job), [job, "value"]).groupBy(job, "_line").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_tokens"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_tokens", lambda t: t["end"]))
    ends = F.concat(F.transform("_tokens", lambda t: t["start"]), F.array(F.length(text)))
    names = F.concat(F.transform("_tokens", lambda t: t["token"]), F.array(F.lit("")))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    woven = F.array_join(F.zip_with(gaps, names, lambda g, t: F.concat(g, t)), "")
    joined = searched.drop("_pieces").join(answers, [job, "_line"], "left")
    return joined.withColumn(text, F.when(F.col("_tokens").isNull(), F.col(text)).otherwise(woven)).drop("_tokens")


def mask_records(records: DataFrame, job: str = "job_id", pos: str = "pos") -> DataFrame:
    """Mask a job's records, each as JSON text, with tokens numbered over the job.

    A job with a record whose masked text does not parse has none. Records without ``pos`` are left out.
    """
    fields = [c for c in records.columns if c not in (job, pos)]
    shape = "struct<" + ",".join(
        f"{pos}:bigint" if c == pos else f"`{c}`:{records.schema[c].dataType.simpleString()}" for c in [pos, *fields]) + ">"
    texts = records.filter(F.col(pos).isNotNull()).select(job, F.col(pos).alias("_pos"), F.to_json(F.struct(pos, *fields)).alias("_text"))
    lines = _numbered(texts, job, F.floor(F.col("_pos") / LINES_PER_SLICE), [F.col("_pos"), F.col("_text")])
    parsed = cut_lineage(_mask_lines(lines, job, "_text").select(job, F.from_json("_text", shape, {"mode": "PERMISSIVE"}).alias("r")))
    broken = parsed.filter(F.col(f"r.{pos}").isNull()).select(job).distinct()
    return parsed.join(broken, job, "left_anti").select(job, *[F.col(f"r.{c}").alias(c) for c in [pos, *fields]])


def mask_urls(urls: DataFrame, job: str = "job_id", pos: str = "pos") -> DataFrame:
    """Mask a job's listed URLs (job, pos, url), each by itself with tokens numbered over the job; blank ones go
    and the others are numbered anew."""
    listed = urls.filter(F.coalesce("url", F.lit("")) != "").select(job, F.col(pos).alias("_pos"), F.col("url").alias("_text"))
    slice_of = F.coalesce(F.floor(F.col("_pos") / LINES_PER_SLICE), F.lit(-1))
    lines = _numbered(listed, job, slice_of, [F.col("_pos"), F.col("_text")])
    return _mask_lines(lines, job, "_text").select(job, F.col("_line").cast("int").alias(pos), F.col("_text").alias("url"))


def _torn(lines: DataFrame, job: str, text: str) -> DataFrame:
    """Jobs with personal data that goes on in the next line: masking would change the number of lines.

    Only lines that begin and end like parts of a number are looked at together.
    """
    plain = lines.select(job, "_line", F.coalesce(text, F.lit("")).alias("_text"))
    going_on = plain.filter(F.col("_text").rlike(r"^[\p{Nd}(]"))
    whole = going_on.withColumn("_before", F.lit(""))
    for back in range(1, _CARRIED_LINES + 1):
        earlier = plain.filter(F.col("_text").rlike(r"[\p{Nd})]$")).select(job, (F.col("_line") + back).alias("_line"), F.col("_text").alias("_more"))
        # Further back only as long as the lines between are parts of a number and nothing else.
        whole = whole.join(earlier, [job, "_line"], "inner" if back == 1 else "left")
        keep = F.lit(True) if back == 1 else (F.size(F.split("_before", "\n")) == back) & F.col("_more").isNotNull()
        whole = whole.withColumn("_before", F.when(keep, F.concat("_more", F.lit("\n"), "_before")).otherwise(F.col("_before"))).drop("_more")
    text_of_all = F.concat("_before", "_text")
    spans = settle(whole.withColumn("_joined", text_of_all), {"_found": pii.rule_spans("_joined")})
    edge = F.length("_before")
    crosses = F.exists("_found", lambda s: (s["start"] < edge) & (s["end"] > edge))
    return spans.filter(crosses).select(job).distinct()


def mask_assets(manifest: DataFrame, job: str = "job_id") -> DataFrame:
    """Mask url and name of a job's merged manifest; a job with data that line ends tear apart is emptied.

    The two columns are masked as separate lists, so their token numbers are independent.
    """
    kinds = F.array_position(F.array(*[F.lit(k) for k in fixed.ASSET_KINDS]), F.col("kind"))
    slice_of = kinds * F.lit(1 << 40) + F.floor(F.col("pos") / LINES_PER_SLICE)
    lines = cut_lineage(_numbered(manifest, job, slice_of, [kinds, F.col("pos"), F.col("url")]))
    torn = _torn(lines, job, "url").unionByName(_torn(lines, job, "name")).distinct()
    whole = lines.join(torn, job, "left_anti")
    masked = whole
    for column in ("url", "name"):
        found = _mask_lines(whole.select(job, "_line", F.coalesce(column, F.lit("")).alias("_text")), job, "_text")
        masked = masked.join(found.withColumnRenamed("_text", f"_{column}"), [job, "_line"])
    name = F.when(F.col("_name") != "", F.col("_name")).otherwise(F.col("name"))
    return masked.withColumn("url", F.col("_url")).withColumn("name", name).select(*manifest.columns)


def fail_closed(envelopes: DataFrame, mask_error: str = "mask_error") -> DataFrame:
    """Envelopes whose masking failed lose all content and derived meta and become errors."""
    failed = F.col(mask_error).isNotNull()

    def unless_failed(column: str) -> Column:
        return F.when(~failed, F.col(column))

    out = envelopes.withColumns(
        {c: unless_failed(c) for c in ("content_md", "content_json") if c in envelopes.columns}
    )
    if "meta" in out.columns:
        out = out.withColumn(
            "meta",
            F.when(
                failed, F.map_filter("meta", lambda k, _: ~k.isin(*fixed.DERIVED_META_KEYS))
            ).otherwise(F.col("meta")),
        )
    return out.withColumns(
        {
            "anonymised": F.when(failed, F.lit(False)).otherwise(F.col("anonymised")),
            "status": F.when(failed, F.lit(fixed.STATUS_ERROR)).otherwise(F.col("status")),
            "error": F.when(failed, F.concat(F.lit(MASK_ERROR + ": "), F.col(mask_error))).otherwise(
                F.col("error")
            ),
        }
    ).drop(mask_error)


def private_extract(
    docs: DataFrame, schema: dict, complete: Callable[[list[str], list[str]], list[str]],
    key: str = "doc_id", text: str = "text", mode: str = "mode", instructions: str | None = None,
) -> DataFrame:
    """Structured extraction under each row's privacy mode: (key, json, error, anonymised, entities).

    Direct rows are sent raw, others masked. In reversible mode the answer gets its values
    back from the row's own tokens, which never leave the job. What is sent is stored first: texts are masked
    once, and masking and completion do not hold a Python worker each in one task. Values are stored encrypted
    with a key of this call.
    """
    secret = F.lit(secrets.token_hex(16))
    reversible = F.col(mode) == fixed.MODE_REVERSIBLE
    masked = mask(docs.filter(F.col(mode) != fixed.MODE_DIRECT), key=key, text=text).select(
        key, mode, F.col("masked").alias("_sent"), "tokens", "entities"
    )
    raw = docs.filter(F.col(mode) == fixed.MODE_DIRECT).select(
        key, mode, F.col(text).alias("_sent"), F.array().cast(pii.TOKEN_TYPE).alias("tokens"),
        F.lit(0).alias("entities"),
    )
    locked = F.transform("tokens", lambda t: F.struct(
        t["token"].alias("token"), F.aes_encrypt(t["value"], secret).alias("value_enc")))
    ready = cut_lineage(raw.unionByName(masked).withColumn("tokens", F.when(reversible, locked)))
    answers = extract_structured(ready, schema, complete, key, "_sent", instructions)
    escaped = F.transform(
        "tokens",
        lambda t: F.struct(
            t["token"].alias("token"),
            # Values return into JSON text, so they are quoted the way JSON quotes them.
            F.regexp_replace(
                F.to_json(F.struct(F.aes_decrypt(t["value_enc"], secret).cast("string").alias("v"))), r'^\{"v":"|"\}$', ""
            ).alias("value"),
        ),
    )
    return answers.join(ready.select(key, mode, "tokens", "entities"), key).select(
        key,
        F.when(reversible, pii.restore_tokens("json", escaped)).otherwise(F.col("json")).alias("json"),
        "error", (F.col(mode) != fixed.MODE_DIRECT).alias("anonymised"), "entities",
    )


def blank(text: Column | str) -> Column:
    """True for texts that masking and extraction leave alone."""
    return strip(text) == ""
