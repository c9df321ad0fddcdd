"""Markdown output, response classes, vectors and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import responses
from webcorpus.functions import text as TX
from webcorpus.functions.vectors import cosine
from webcorpus.operators import crawl, extraction, vectors
from webcorpus.operators.fetchlog import counts_by
from webcorpus.plans.catalog import query, spread_table, table

STRIP_SQL = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


def headed_documents(spark, sf):
    """Documents as markdown; two in three open with a heading."""
    heading = F.when(
        F.col("doc_id") % 3 != 0, F.concat(F.lit("\n ## Doc "), "doc_id", F.lit(" \n\n"))
    ).otherwise(F.lit(""))
    return spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.concat(heading, "text").alias("md"),
        F.concat(F.lit("http://d.example/"), "doc_id").alias("url"),
    )


_MD_SQL = "CASE WHEN doc_id % 3 <> 0 THEN chr(10) || ' ## Doc ' || doc_id || ' ' || chr(10) || chr(10) ELSE '' END || text"
_TITLE_SQL = """CASE WHEN doc_id % 3 <> 0 THEN 'Doc ' || doc_id
    WHEN starts_with(ltrim(text, ' ' || chr(10)), '#') THEN
    nullif(trim(ltrim(split_part(ltrim(text, ' ' || chr(10)), chr(10), 1), '#')), '') END"""


@query("title_from_markdown", f"SELECT doc_id, {_TITLE_SQL} AS title FROM documents")
def _title(spark, sf):
    return headed_documents(spark, sf).select("doc_id", TX.title_from_markdown("md").alias("title"))


@query("llms_txt", f"""
    SELECT doc_id, '# ' || coalesce({_TITLE_SQL}, 'Documento') || chr(10) || chr(10) || '> Fuente: http://d.example/' || doc_id
        || chr(10) || chr(10) || {STRIP_SQL.format('(' + _MD_SQL + ')')} || chr(10) AS llms_txt FROM documents""")
def _llms(spark, sf):
    return crawl.llms_txt(headed_documents(spark, sf), "md", "url").select("doc_id", "llms_txt")


@query("bundle", f"""
    SELECT conv_id, string_agg('## http://c.example/' || conv_id || '/' || turn || chr(10) || chr(10) || {STRIP_SQL.format('text')},
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) || chr(10) AS content_md
    FROM conversations GROUP BY conv_id""")
def _bundle(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text").withColumn(
        "url", F.concat(F.lit("http://c.example/"), "conv_id", F.lit("/"), "turn")
    )
    return crawl.bundle(turns, "conv_id", "turn", "url", "text")


_CHALLENGES = ["<p>plain</p>", "<div class=g-recaptcha></div>", "<script src=//js.hcaptcha.com/1></script>",
               "<title>Just a moment...</title><div class=g-recaptcha>", "geo.captcha-delivery.com", "<p id=px-captcha>",
               "arkoselabs funcaptcha"]


def fetched_pages(spark, sf):
    """Pages as responses: a challenge in some, a status per key."""
    mark = F.get(F.array(*[F.lit(c) for c in _CHALLENGES]), (F.col("page_id") % 7).cast("int"))
    status = F.get(F.array(*[F.lit(c) for c in (200, 403, 429, 503, 200)]), (F.col("page_id") % 5).cast("int"))
    headers = F.when(F.col("page_id") % 4 == 1, F.create_map(F.lit("X-DataDome"), F.lit("1"))).otherwise(
        F.create_map(F.lit("Server"), F.lit("nginx"))
    )
    body = F.when(F.col("page_id") % 10 == 0, F.lit("  short ")).otherwise(F.concat("html", mark))
    return spread_table(spark, sf, "pages", "page_id", "url", "html").select(
        "page_id", "url", status.alias("status"), headers.alias("headers"), body.alias("body")
    )


_VENDOR_SQL = """CASE WHEN page_id % 10 = 0 THEN NULL ELSE list_extract([NULL, 'recaptcha', 'hcaptcha', 'cloudflare',
    'datadome', 'perimeterx', 'arkose'], CAST(page_id % 7 + 1 AS INT)) END"""


@query("detect_captcha", f"SELECT page_id, {_VENDOR_SQL} AS vendor FROM pages")
def _captcha(spark, sf):
    return fetched_pages(spark, sf).select("page_id", responses.detect_captcha("body").alias("vendor"))


@query("captchas_by_vendor", f"SELECT coalesce({_VENDOR_SQL}, 'none') AS vendor, count(*) AS total FROM pages GROUP BY 1")
def _captchas(spark, sf):
    return counts_by(fetched_pages(spark, sf).select(responses.detect_captcha("body").alias("vendor")), "vendor")


@query("header_block", "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'datadome' END AS vendor FROM pages")
def _headers(spark, sf):
    return fetched_pages(spark, sf).select("page_id", responses.header_block("headers").alias("vendor"))


@query("classify_response", f"""
    WITH v AS (SELECT page_id, {_VENDOR_SQL} AS vendor, list_extract([200, 403, 429, 503, 200], CAST(page_id % 5 + 1 AS INT)) AS status FROM pages)
    SELECT page_id,
        CASE WHEN vendor IS NOT NULL THEN 'captcha' WHEN page_id % 4 = 1 OR status <> 200 OR page_id % 10 = 0 THEN 'blocked' ELSE 'ok' END AS class,
        CASE WHEN vendor IS NOT NULL THEN vendor WHEN page_id % 4 = 1 THEN 'waf:datadome' WHEN status <> 200 THEN 'status:' || status
             WHEN page_id % 10 = 0 THEN 'empty_body' ELSE '' END AS signal
    FROM v""")
def _classify(spark, sf):
    verdict = responses.classify_response("status", "headers", "body", 64)
    return fetched_pages(spark, sf).select("page_id", verdict.alias("v")).select("page_id", "v.class", "v.signal")


_MESSAGES = ["Sign in to confirm you are over 18", "HTTP 404", "ERROR: use --cookies", "This video may be inappropriate",
             "account on this device", "timeout"]


@query("auth_wall", """
    SELECT event_id, event_id % 6 IN (0, 2, 4) AS media, event_id % 6 IN (0, 2, 3) AS comments FROM events""")
def _wall(spark, sf):
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events", "event_id").select(
        "event_id", responses.media_auth_wall(message).alias("media"),
        responses.comment_auth_wall(message).alias("comments"),
    )


@query("cosine", """
    SELECT a.vec_id, round(CASE WHEN a.vec_id % 10 = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id // 2)""")
def _cosine(spark, sf):
    vecs = table(spark, sf, "embeddings", "vec_id", "embedding")
    left = vecs.select(
        "vec_id", F.floor(F.col("vec_id") / 2).alias("half"),
        # Every tenth vector is cut short: unequal lengths have no similarity.
        F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("a"),
    )
    return left.join(vecs.select(F.col("vec_id").alias("half"), F.col("embedding").alias("b")), "half").select(
        "vec_id", F.round(cosine("a", "b"), 6).alias("similarity")
    )


@query("vector_top_k", """
    WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id,
                      round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS similarity
               FROM embeddings q, embeddings v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
    SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def _top_k(spark, sf):
    vecs = table(spark, sf, "embeddings", "vec_id", "embedding")
    queries = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.top_k(queries, vecs).withColumn("similarity", F.round("similarity", 6))


@query("embed", f"""
    SELECT doc_id, length(text)::DOUBLE AS size, length(regexp_replace(text, '[^a-z]', '', 'g'))::DOUBLE AS lower
    FROM documents WHERE {STRIP_SQL.format('text')} <> ''""")
def _embed(spark, sf):
    def embedding(texts):
        return [[float(len(t)), float(sum("a" <= c <= "z" for c in t))] for t in texts]

    done = vectors.embed(table(spark, sf, "documents", "doc_id", "text"), embedding)
    return done.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("lower")
    )


_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "note": {"type": "string"}}}


@query("build_prompt", f"""
    SELECT doc_id, '{fixed.CONTENT_OPEN}' || chr(10) || text || chr(10) || '{fixed.CONTENT_CLOSE}' AS user_part FROM documents""")
def _prompt(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", extraction.build_prompt("text", _SCHEMA)["user"].alias("user_part")
    )


def answers(spark, sf):
    """Model answers of every shape around the events' JSON."""
    p = F.col("props")
    fence = F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone"))
    shapes = [p, fence, F.concat(F.lit("Result: "), p, F.lit(" ok")), F.lit("no data"), F.concat(F.lit("["), p, F.lit("]")),
              F.replace(p, F.lit('"k"'), F.lit('"other"')), F.regexp_replace(p, r"(\d+)", '"$1"')]
    return table(spark, sf, "events", "event_id", "props").select(
        "event_id", F.get(F.array(*shapes), (F.col("event_id") % 7).cast("int")).alias("raw")
    )


@query("parse_answer", """
    SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN props WHEN event_id % 7 = 5 THEN replace(props, '"k"', '"other"')
            WHEN event_id % 7 = 6 THEN regexp_replace(props, '(\\d+)', '"\\1"') END AS json,
           event_id % 7 = 3 AS not_json, event_id % 7 = 4 AS not_object FROM events""")
def _parse(spark, sf):
    parsed = answers(spark, sf).select("event_id", extraction.parse_answer("raw").alias("a"))
    return parsed.select(
        "event_id", "a.json", F.coalesce(F.col("a.error") == extraction.NOT_JSON, F.lit(False)).alias("not_json"),
        F.coalesce(F.col("a.error") == extraction.NOT_OBJECT, F.lit(False)).alias("not_object"),
    )


@query("validate_json", """
    SELECT event_id, event_id % 7 IN (0, 1, 2) AS valid,
           CASE event_id % 7 WHEN 5 THEN '$: k is required' WHEN 6 THEN '$.k: not integer' ELSE '' END AS errors FROM events""")
def _validate(spark, sf):
    parsed = answers(spark, sf).select("event_id", extraction.parse_answer("raw")["json"].alias("json"))
    return extraction.validate_json(parsed, _SCHEMA).select(
        "event_id", "valid", F.array_join("errors", "; ").alias("errors")
    )


_LISTING_SCHEMA = {
    "type": "object", "required": ["results", "total"], "additionalProperties": {"type": "object"},
    "properties": {
        "total": {"type": "integer", "maximum": 12}, "filters": {"type": "array", "items": {"properties": {"tag": {"pattern": "^[ab]$"}}}},
        "results": {"type": "array", "maxItems": 12, "items": {
            "type": "object", "required": ["id"], "properties": {
                "Title": {"properties": {"text": {"enum": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "lang": {"const": "x"}}},
                "offer": {"properties": {"current_price": {"properties": {"amount": {"maximum": 200000}}}}},
                "permalink": {"type": "string", "pattern": "^http://o[.]example/[0-9]+#track$"},
                "tags": {"uniqueItems": True, "minItems": 2, "items": {"type": "object", "properties": {"name": {"enum": ["n", "m"]}}}},
            },
        }},
    },
}


@query("validate_nested", """
    WITH o AS (SELECT o_custkey AS doc, '$.results[' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || ']' AS place,
                      o_orderpriority AS p, floor(o_totalprice) AS price FROM orders),
    e AS (SELECT doc, place || '.Title.text: not one of ["1-URGENT", "2-HIGH", "3-MEDIUM"]' AS error FROM o WHERE p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
          UNION ALL SELECT doc, place || '.offer.current_price.amount: more than 200000' FROM o WHERE price > 200000
          UNION ALL SELECT doc, unnest(['$.results: more than 12 items', '$.total: more than 12']) FROM o GROUP BY doc HAVING count(*) > 12)
    SELECT doc, count(error) = 0 AS valid, coalesce(string_agg(error, chr(10) ORDER BY error), '') AS errors
    FROM (SELECT DISTINCT doc FROM o) LEFT JOIN e USING (doc) GROUP BY doc""")
def _validate_nested(spark, sf):
    from webcorpus.plans.catalog.records import listing_documents

    listed = listing_documents(spark, sf).withColumnRenamed("body", "json")
    return extraction.validate_json(listed, _LISTING_SCHEMA).select("doc", "valid", F.array_join(F.array_sort("errors"), "\n").alias("errors"))


@query("extract_structured", """
    SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN '{"k": ' || length(text) || '}' END AS json,
           CASE WHEN doc_id % 5 = 0 THEN 'schema: $: k is required' END AS error FROM documents""")
def _extract(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.concat("doc_id", F.lit("|"), F.length("text"), F.lit("|"), "text").alias("text")
    )

    def complete(systems, users):
        heads = [user.split("\n", 1)[1].split("|", 2) for user in users]
        return ['{"k": %s}' % size if int(doc) % 5 else "{}" for doc, size, _ in heads]

    return extraction.extract_structured(docs, _SCHEMA, complete)
