"""Privacy operators over documents and over texts derived from business tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from webcorpus.functions import pii
from webcorpus.functions.rows import explode_once
from webcorpus.operators import policy, privacy
from webcorpus.plans.catalog import query, spread_table, table

KEY = "catalogue-key-16"
NOW = datetime(2024, 6, 1)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SQL_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "IP": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "CUIT": r"\b(?:20|23|24|27|30|33|34)[-\s]?\d{8}[-\s]?\d\b",
}


def _luhn_sql(digits: str) -> str:
    return f"""(length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({digits})),
        lambda i: CASE WHEN i % 2 = 0 THEN ord({digits}[length({digits}) - i]) - 48
        WHEN ord({digits}[length({digits}) - i]) - 48 > 4 THEN (ord({digits}[length({digits}) - i]) - 48) * 2 - 9
        ELSE (ord({digits}[length({digits}) - i]) - 48) * 2 END)) % 10 = 0)"""


def _spans_sql(kind: str) -> str:
    pattern = _SQL_PATTERNS[kind]
    return f"""SELECT doc_id, '{kind}' AS type, m[i] AS value,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_split_to_array(text, '{pattern}') AS g,
              unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS i FROM documents)"""


_ALL_SPANS_SQL = " UNION ALL ".join(_spans_sql(k) for k in _SQL_PATTERNS)


@query("detect_spans", f"""
    SELECT doc_id, type, s AS "start", s + length(value) AS "end" FROM ({_ALL_SPANS_SQL})""")
def _detect(spark, sf):
    kinds = tuple(_SQL_PATTERNS)
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    return explode_once(docs, ["doc_id"], pii.rule_spans("text", kinds), None, "s").select(
        "doc_id", "s.type", "s.start", "s.end"
    )


# SQL has no look-behind: the character before a match is part of the pattern and not of the value.
# Its word edges know ASCII letters only, so every letter becomes one, which keeps all offsets.
_BEFORE_SQL = {
    "TARJETA": (r"\b", r"(?:\d[ \-]?){13,19}"),
    "TEL": (r"^|[^\w.]", r"(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]){1,3}\d{3,4}"),
}


def _spans_after_sql(kind: str) -> str:
    before, body = _BEFORE_SQL[kind]
    pattern = rf"(?:{before})(?:{body})\b"
    value = f"regexp_extract(m[i], '(?:{before})({body})$', 1)"
    return f"""SELECT doc_id, '{kind}' AS type, {value} AS value,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)
            + length(m[i]) - length({value}) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_split_to_array(text, '{pattern}') AS g,
              unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS i
              FROM (SELECT doc_id, regexp_replace(text, '\\p{{L}}', 'x', 'g') AS text FROM documents))"""


_DIGITS_SQL = "regexp_replace(value, '[^0-9]', '', 'g')"
_EVERY_SPAN_SQL = f"""
    SELECT doc_id, s AS "start", s + length(value) AS "end", type,
           list_position(['EMAIL', 'IP', 'CUIT', 'TARJETA', 'TEL'], type) AS seq
    FROM ({_ALL_SPANS_SQL} UNION ALL {_spans_after_sql('TARJETA')} UNION ALL {_spans_after_sql('TEL')})
    WHERE (type <> 'TARJETA' OR {_luhn_sql(_DIGITS_SQL)}) AND (type <> 'TEL' OR length({_DIGITS_SQL}) BETWEEN 8 AND 15)"""


@query("detect_all_spans", _EVERY_SPAN_SQL)
def _detect_all(spark, sf):
    return privacy.detect_spans(spread_table(spark, sf, "documents", "doc_id", "text"))


@query("luhn_ok", f"""
    WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919 * 104729)::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 16 END, '4') AS n FROM orders)
    SELECT o_orderkey, {_luhn_sql('n')} AS ok FROM d""")
def _luhn(spark, sf):
    number = (F.col("o_orderkey") * 7919 * 104729).cast("string")
    digits = F.when(F.col("o_orderkey") % 5 == 0, F.lpad(number, 12, "4")).otherwise(F.lpad(number, 16, "4"))
    return table(spark, sf, "orders", "o_orderkey").select("o_orderkey", pii.luhn_ok(digits).alias("ok"))


@query("phone_ok", """
    SELECT c_custkey, length(c_custkey::VARCHAR || (c_custkey * c_custkey)::VARCHAR) BETWEEN 8 AND 15 AS ok FROM customer""")
def _phone(spark, sf):
    fragment = F.concat(F.lit("+"), "c_custkey", F.lit(" - "), F.col("c_custkey") * F.col("c_custkey"))
    return table(spark, sf, "customer", "c_custkey").select("c_custkey", pii.phone_ok(fragment).alias("ok"))


@query("mask", f"""
    WITH found AS ({_spans_sql('EMAIL')}),
    firsts AS (SELECT doc_id, value, min(s) AS s FROM found GROUP BY ALL),
    numbered AS (SELECT doc_id, value, '«EMAIL_' || row_number() OVER (PARTITION BY doc_id ORDER BY s) || '»' AS token FROM firsts),
    maps AS (SELECT doc_id, map(list(value), list(token)) AS m, count(*) AS n FROM numbered GROUP BY doc_id),
    pieces AS (SELECT doc_id, regexp_extract_all(text, '{_SQL_PATTERNS["EMAIL"]}', 0) AS v,
                      regexp_split_to_array(text, '{_SQL_PATTERNS["EMAIL"]}') AS g, text FROM documents)
    SELECT p.doc_id, coalesce(m.n, 0) AS entities, CASE WHEN m.n IS NULL THEN p.text ELSE
        list_reduce(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(v) THEN m.m[v[i]] ELSE '' END),
        lambda a, b: a || b) END AS masked
    FROM pieces p LEFT JOIN maps m USING (doc_id)""")
def _mask_emails(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text").withColumn("found", pii.rule_spans("text", ("EMAIL",)))
    return pii.mask_text(docs, "text", "found").select("doc_id", "entities", "masked")


@query("mask_all_kinds", f"""
    WITH found AS ({_EVERY_SPAN_SQL}),
    reached AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END)
                       OVER (PARTITION BY doc_id ORDER BY "start", "end", seq) AS island FROM reached),
    merged AS (SELECT doc_id, island, min("start") AS a, max("end") AS b, arg_min(type, "start" * 1000000000 + "end" * 10 + seq) AS type FROM islands GROUP BY ALL),
    pieces AS (SELECT m.*, substring(d.text, (a + 1)::BIGINT, (b - a)::BIGINT) AS value, d.text FROM merged m JOIN documents d USING (doc_id)),
    firsts AS (SELECT doc_id, value, min(a) AS a, arg_min(type, a) AS type FROM pieces GROUP BY ALL),
    tokens AS (SELECT doc_id, value, '«' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY a) || '»' AS token FROM firsts),
    woven AS (SELECT p.doc_id, string_agg(substring(p.text, (p.before + 1)::BIGINT, (p.a - p.before)::BIGINT) || t.token, '' ORDER BY p.a) AS head, max(p.b) AS b
              FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM pieces) p JOIN tokens t USING (doc_id, value) GROUP BY p.doc_id)
    SELECT d.doc_id, CASE WHEN w.doc_id IS NULL THEN d.text ELSE w.head || substring(d.text, (w.b + 1)::BIGINT) END AS masked,
           coalesce(n.entities, 0) AS entities
    FROM documents d LEFT JOIN woven w USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS entities FROM tokens GROUP BY doc_id) n USING (doc_id)""")
def _mask_all(spark, sf):
    return privacy.mask(spread_table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "masked", "entities")


def contact_notes(spark, sf):
    """A note per order that names its customer's address once and the clerk's twice."""
    customer = F.concat(F.lit("u"), "o_custkey", F.lit("@mail.example"))
    clerk = F.concat(F.lit("clerk"), F.col("o_orderkey") % 7, F.lit("@shop.example"))
    note = F.concat(clerk, F.lit(" wrote to "), customer, F.lit("; copy for "), clerk, F.lit("."))
    return spread_table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_orderkey").alias("doc_id"), note.alias("text"), "o_custkey"
    )


_CLERK = "'clerk' || (o_orderkey % 7) || '@shop.example'"
_CUST = "'u' || o_custkey || '@mail.example'"
_NOTE_SQL = f"{_CLERK} || ' wrote to ' || {_CUST} || '; copy for ' || {_CLERK} || '.'"
_MASKED_NOTE = "'«EMAIL_1» wrote to «EMAIL_2»; copy for «EMAIL_1».'"


@query("mask_notes", f"SELECT o_orderkey AS doc_id, {_MASKED_NOTE} AS masked, 2 AS entities FROM orders")
def _mask_notes(spark, sf):
    return privacy.mask(contact_notes(spark, sf)).select("doc_id", "masked", "entities")


@query("entity_counts", "SELECT o_orderkey AS doc_id, 'EMAIL' AS type, 2 AS entities FROM orders")
def _entities(spark, sf):
    return privacy.entity_counts(privacy.mask(contact_notes(spark, sf)))


def found_outside(spark, sf):
    """External detections per order: the customer by offset, the clerk by quotation, one that fails."""
    notes = contact_notes(spark, sf)
    start = F.instr("text", " wrote to ") + 9
    def span(seq, begin, end, quoted, placeholder):
        return F.struct(
            F.lit(seq).alias("seq"), begin.alias("start"), end.alias("end"),
            F.lit(quoted).cast("string").alias("text"), F.lit(placeholder).alias("placeholder"),
        )

    spans = F.array(
        span(0, start, F.instr("text", ";") - 1, None, "<PRIVATE_PERSON>"),
        span(1, F.lit(900), F.lit(901), "copy for", "<ODD>"),
        span(2, F.lit(-1), F.lit(5), "absent", "<SECRET>"),
    )
    return notes.select("doc_id", F.inline(spans))


@query("locate_external_spans", f"""
    WITH n AS (SELECT o_orderkey AS doc_id, {_NOTE_SQL} AS text FROM orders)
    SELECT doc_id, strpos(text, ' wrote to ') + 9 AS "start", strpos(text, ';') - 1 AS "end", 'PERSONA' AS type FROM n
    UNION ALL SELECT doc_id, strpos(text, 'copy for') - 1, strpos(text, 'copy for') + 7, 'DATO' FROM n""")
def _external(spark, sf):
    return privacy.locate_external_spans(contact_notes(spark, sf), found_outside(spark, sf))


@query("mask_external", "SELECT o_orderkey AS doc_id, '«EMAIL_1» wrote to «PERSONA_1»; «DATO_1» «EMAIL_1».' AS masked FROM orders")
def _mask_external(spark, sf):
    return privacy.mask(contact_notes(spark, sf), found_outside(spark, sf)).select("doc_id", "masked")


@query("merge_spans", """
    WITH spans AS (SELECT l_orderkey AS doc_id, (l_partkey % 90)::INT AS s, (l_partkey % 90 + l_quantity)::INT AS e, l_returnflag AS type,
                          l_linenumber AS seq FROM lineitem),
    reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, seq, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
    islands AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, seq, type) AS i FROM reach)
    SELECT doc_id, min(s) AS "start", max(e) AS "end", arg_min(type, (s, e, seq, type)) AS type FROM islands GROUP BY doc_id, i""")
def _merge(spark, sf):
    start = (F.col("l_partkey") % 90).cast("int")
    spans = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber").select(
        F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"),
        F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("seq"),
    )
    return privacy.merge_spans(spans)


_ROLES = ("humano", "angel", "dios")


def role_of(column: str):
    return F.get(F.array(*[F.lit(r) for r in _ROLES]), (F.col(column) % 3).cast("int"))


ROLE_SQL = "list_extract(['humano', 'angel', 'dios'], CAST({0} % 3 + 1 AS INT))"


@query("mask_reversible", f"""
    SELECT o_orderkey AS doc_id, {ROLE_SQL.format('o_orderkey')} AS role, t.token,
           CASE t.token WHEN '«EMAIL_1»' THEN {_CLERK} ELSE {_CUST} END AS value
    FROM orders, (VALUES ('«EMAIL_1»'), ('«EMAIL_2»')) AS t(token)""")
def _reversible(spark, sf):
    docs = contact_notes(spark, sf).withColumn("role", role_of("doc_id"))
    _, maps = privacy.mask_reversible(docs, KEY, NOW)
    value = F.aes_decrypt(F.col("value_enc"), F.lit(KEY)).cast("string")
    return maps.select("doc_id", "role", "token", value.alias("value"))


@query("rehydrate", f"SELECT o_orderkey AS doc_id, {_NOTE_SQL} AS content FROM orders")
def _rehydrate(spark, sf):
    masked, maps = privacy.mask_reversible(contact_notes(spark, sf).withColumn("role", F.lit("dios")), KEY, NOW)
    docs = masked.select("doc_id", "ref", F.col("masked").alias("content"))
    return privacy.rehydrate(docs, privacy.open_maps(maps, KEY)).select("doc_id", "content")


@query("revert", f"""
    WITH r AS (SELECT o_orderkey AS doc_id, {_NOTE_SQL} AS note FROM orders)
    SELECT doc_id * 10 + n AS request_id, CASE
        WHEN n = 0 THEN 'role_not_allowed'
        WHEN doc_id % 4 = 0 THEN 'gone'
        WHEN n = 1 AND doc_id % 4 = 1 THEN 'wrong_owner' WHEN n = 1 THEN 'ok' ELSE 'gone' END AS status,
        CASE WHEN n = 1 AND doc_id % 4 >= 2 THEN note END AS content
    FROM r, (VALUES (0), (1), (2)) AS t(n)""")
def _revert(spark, sf):
    docs = contact_notes(spark, sf).withColumn("role", F.lit("angel"))
    masked, maps = privacy.mask_reversible(docs, KEY, NOW)
    number = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    requests = masked.select("doc_id", "ref", "masked", number).select(
        (F.col("doc_id") * 10 + F.col("n")).alias("request_id"),
        (F.lit(NOW) + F.make_dt_interval(secs=F.col("n"))).alias("asked_at"), "ref",
        F.when(F.col("n") == 0, "humano").when((F.col("n") == 1) & (F.col("doc_id") % 4 == 1), "dios")
        .otherwise("angel").alias("role"),
        F.col("masked").alias("content"),
    )
    consumed = masked.filter(F.col("doc_id") % 4 == 0).select("ref")
    answers, _ = privacy.revert(requests, maps, consumed, KEY, NOW + timedelta(hours=1))
    return answers.select("request_id", "status", "content")


_REQUESTED = (None, "opaco", "reversible", "directo")


@query("resolve_mode", f"""
    WITH r AS (SELECT c_custkey, {ROLE_SQL.format('c_custkey')} AS role,
                      list_extract([NULL, 'opaco', 'reversible', 'directo'], CAST(c_custkey // 3 % 4 + 1 AS INT)) AS wanted FROM customer)
    SELECT c_custkey, CASE WHEN wanted IS NULL THEN CASE role WHEN 'dios' THEN 'directo' ELSE 'opaco' END
        WHEN role = 'dios' OR wanted = 'opaco' OR (role = 'angel' AND wanted = 'reversible') THEN wanted END AS mode FROM r""")
def _mode(spark, sf):
    wanted = F.get(
        F.array(*[F.lit(m).cast("string") for m in _REQUESTED]), (F.floor(F.col("c_custkey") / 3) % 4).cast("int")
    )
    return table(spark, sf, "customer", "c_custkey").select(
        "c_custkey", policy.resolve_mode(role_of("c_custkey"), wanted)["mode"].alias("mode")
    )


@query("effective_role", f"""
    WITH r AS (SELECT c_custkey, c_custkey % 3 AS own, c_custkey // 3 % 3 AS wanted FROM customer)
    SELECT c_custkey, CASE WHEN wanted <= own THEN {ROLE_SQL.format('wanted')} ELSE {ROLE_SQL.format('own')} END AS role FROM r""")
def _role(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey").withColumn("third", F.floor(F.col("c_custkey") / 3))
    return customers.select("c_custkey", policy.effective_role(role_of("c_custkey"), role_of("third")).alias("role"))


@query("check_capabilities", f"""
    WITH r AS (SELECT o_orderkey, {ROLE_SQL.format('o_orderkey')} AS role, o_orderkey // 3 AS k FROM orders)
    SELECT o_orderkey, concat_ws(',',
        CASE WHEN k % 4 > CASE role WHEN 'dios' THEN 3 WHEN 'angel' THEN 2 ELSE 1 END THEN 'tier' END,
        CASE WHEN k % 2 = 1 AND role = 'humano' THEN 'capture' END, CASE WHEN k % 5 = 1 AND role = 'humano' THEN 'proxy' END,
        CASE WHEN k % 7 = 1 AND role <> 'dios' THEN 'solver' END, CASE WHEN k % 3 > 0 AND role = 'humano' THEN 'crawl' END,
        CASE WHEN k % 11 = 1 AND role <> 'dios' THEN 'data_tree' END, CASE WHEN k % 13 = 1 AND role <> 'dios' THEN 'browser_cookies' END) AS denials
    FROM r""")
def _caps(spark, sf):
    k = F.floor(F.col("o_orderkey") / 3)
    wishes = table(spark, sf, "orders", "o_orderkey").select(
        "o_orderkey", role_of("o_orderkey").alias("role"), (k % 4).cast("int").alias("tier_hint"),
        (k % 2 == 1).alias("capture_api"), F.when(k % 5 == 1, "http://p").alias("proxy"),
        F.when(k % 7 == 1, "http://s").alias("captcha_api_url"), F.when(k % 7 == 1, "key").alias("captcha_api_key"),
        (k % 3).cast("int").alias("crawl_depth"), (k % 2 == 0).alias("paginate"), (k % 11 == 1).alias("data_tree"),
        F.when(k % 13 == 1, "firefox").alias("cookies_browser"),
    )
    return policy.check_capabilities(wishes).select("o_orderkey", F.array_join("denials", ",").alias("denials"))


@query("apply_privacy", f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN {_NOTE_SQL} ELSE {_MASKED_NOTE} END AS text,
           o_orderkey % 3 <> 0 AS anonymised, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS entities FROM orders""")
def _apply(spark, sf):
    modes = F.array(F.lit("directo"), F.lit("opaco"), F.lit("reversible"))
    docs = contact_notes(spark, sf).select("doc_id", "text", F.get(modes, (F.col("doc_id") % 3).cast("int")).alias("mode"))
    return privacy.apply_privacy(docs).drop("mode")


@query("fail_closed", """
    SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN text END AS content_md, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS status,
           doc_id % 4 <> 0 AS anonymised, CASE WHEN doc_id % 4 = 0 THEN 'lang' ELSE 'files,lang' END AS meta_keys FROM documents""")
def _closed(spark, sf):
    env = table(spark, sf, "documents", "doc_id", "text", "lang").select(
        "doc_id", F.col("text").alias("content_md"), F.lit(None).cast("string").alias("content_json"),
        F.lit(True).alias("anonymised"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
        F.create_map(F.lit("lang"), "lang", F.lit("files"), F.lit("[]")).alias("meta"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("detector down")).alias("mask_error"),
    )
    return privacy.fail_closed(env).select(
        "doc_id", "content_md", "status", "anonymised", F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("meta_keys")
    )


def order_positions(spark, sf):
    """Orders as list items of their customer: position counts from zero."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumn("pos", turn)


@query("mask_records", """
    SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
           'mail «EMAIL_1», order «EMAIL_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1) || '»' AS title,
           o_orderkey % 100 AS price FROM orders""")
def _records(spark, sf):
    title = F.concat(
        F.lit("mail u"), "o_custkey", F.lit("@mail.example, order o"), "o_orderkey", F.lit("@shop.example")
    )
    records = order_positions(spark, sf).select(
        F.col("o_custkey").alias("job_id"), F.col("pos").cast("long").alias("pos"), title.alias("title"),
        (F.col("o_orderkey") % 100).alias("price"),
    )
    return privacy.mask_records(records)


@query("mask_urls", """
    WITH o AS (SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
    SELECT job_id, pos, 'http://h.example/' || pos || '?m=«EMAIL_' || (pos + 1) || '»' AS url FROM o""")
def _urls(spark, sf):
    url = F.concat(F.lit("http://h.example/"), "pos", F.lit("?m=o"), "o_orderkey", F.lit("@shop.example"))
    listed = order_positions(spark, sf)
    return privacy.mask_urls(listed.select(F.col("o_custkey").alias("job_id"), "pos", url.alias("url")))


@query("mask_assets", """
    WITH o AS (SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
    SELECT job_id, pos, 'http://h.example/«EMAIL_' || pos || '»/f.pdf' AS url, 'for «EMAIL_1» ' || pos || 'x' AS name FROM o""")
def _files(spark, sf):
    files = order_positions(spark, sf).select(
        F.col("o_custkey").alias("job_id"), F.lit("document").alias("kind"), (F.col("pos") + 1).alias("pos"),
        F.concat(F.lit("http://h.example/o"), "o_orderkey", F.lit("@shop.example/f.pdf")).alias("url"),
        F.concat(F.lit("for u"), "o_custkey", F.lit("@mail.example "), F.col("pos") + 1, F.lit("x")).alias("name"),
    )
    return privacy.mask_assets(files).select(
        "job_id", "pos", "url", "name"
    )


@query("private_extract", f"""
    SELECT o_orderkey AS doc_id, '{{"from": "' || CASE WHEN o_orderkey % 3 = 1 THEN '«EMAIL_1»' ELSE {_CLERK} END || '"}}' AS json,
           o_orderkey % 3 <> 0 AS anonymised FROM orders""")
def _private_extract(spark, sf):
    modes = F.array(F.lit("directo"), F.lit("opaco"), F.lit("reversible"))
    docs = contact_notes(spark, sf).select("doc_id", "text", F.get(modes, (F.col("doc_id") % 3).cast("int")).alias("mode"))

    def complete(systems, users):
        return ['{"from": "%s"}' % user.split("\n")[1].split(" wrote")[0] for user in users]

    schema = {"type": "object", "required": ["from"]}
    return privacy.private_extract(docs, schema, complete).select("doc_id", "json", "anonymised")
