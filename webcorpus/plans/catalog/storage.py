"""Sources, sinks and keyed merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webcorpus.functions import sql as sql_functions
from webcorpus.plans.catalog import query, table
from webcorpus.plans.catalog.html import MARKUP_SQL
from webcorpus.plans.catalog.urls import HOST_SQL, PATH_SQL, QUERY_SQL
from webcorpus.session import shared_dir
from webcorpus.sources import envelopes, feeds, pages, sinks


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"


@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _read(spark, sf):
    return pages.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("chars"))


@query("decode_body", "SELECT doc_id, text, length(text) AS chars FROM documents")
def _decode(spark, sf):
    third = F.col("doc_id") % 3
    raw = table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        F.when(third == 0, F.encode("text", "UTF-8")).when(third == 1, F.encode("text", "UTF-8"))
        .otherwise(F.encode("text", "UTF-16BE")).alias("content"),
        F.when(third == 0, F.lit("text/html; charset=UTF-8")).when(third == 1, F.lit("text/plain"))
        .otherwise(F.lit('text/html; charset="utf-16-be"')).alias("content_type"),
    )
    return pages.decode_body(raw, max_bytes=1 << 30).select("doc_id", "text", F.length("text").alias("chars"))


def _xml(spark, sf):
    """Sitemaps for even suppliers, Atom feeds for odd ones, and every tenth one broken."""
    number = F.col("s_suppkey").cast("string")
    body = F.when(
        F.col("s_suppkey") % 10 == 0, F.lit("<urlset><loc>http://x")
    ).when(
        F.col("s_suppkey") % 2 == 0,
        F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example/'), number,
                 F.lit(" </loc></url><url><loc>ftp://no</loc></url><url><loc>http://t.example/"), number,
                 F.lit("</loc></url></urlset>")),
    ).otherwise(
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://a.example/'), number,
                 F.lit('"/></entry><entry><link>http://b.example/'), number, F.lit("</link></entry></feed>")),
    )
    return table(spark, sf, "supplier", "s_suppkey").select("s_suppkey", body.alias("xml"))


@query("sitemap_urls", """
    SELECT s_suppkey, pos, prefix || s_suppkey AS link FROM supplier, (VALUES (0, 'https://s.example/'), (1, 'http://t.example/')) AS t(pos, prefix)
    WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0""")
def _sitemaps(spark, sf):
    return feeds.sitemap_urls(_xml(spark, sf))


@query("feed_urls", """
    SELECT s_suppkey, pos, prefix || s_suppkey AS link FROM supplier, (VALUES (0, 'https://a.example/'), (1, 'http://b.example/')) AS t(pos, prefix)
    WHERE s_suppkey % 2 = 1""")
def _feeds(spark, sf):
    return feeds.feed_urls(_xml(spark, sf))


def _stored(spark, sf):
    return table(spark, sf, "customer", "c_custkey").filter(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("http://old/"), "c_custkey").alias("source_url"),
        F.lit("pendiente").alias("status"), F.lit(None).cast("string").alias("content_md"),
        F.lit(None).cast("int").alias("tier"), F.create_map(F.lit("n"), F.lit("0")).alias("meta"),
    )


def _updates(spark, sf):
    rows = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit("http://new/"), "o_custkey").alias("source_url"),
        F.col("o_orderstatus").alias("status"), F.concat(F.lit("order "), "o_orderkey").alias("content_md"),
        (F.col("o_orderkey") % 4).cast("int").alias("tier"),
        F.create_map(F.lit("n"), F.col("o_orderkey").cast("string"), F.lit("cookies"), F.lit("secret")).alias("meta"),
        "o_orderkey",
    )
    return envelopes.latest_by_key(rows, "job_id", ["o_orderkey"]).drop("o_orderkey")


@query("upsert_envelopes", """
    WITH u AS (SELECT o_custkey AS job_id, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1),
    o AS (SELECT c_custkey AS job_id FROM customer WHERE c_custkey % 3 <> 0)
    SELECT job_id, CASE WHEN o.job_id IS NOT NULL THEN 'http://old/' ELSE 'http://new/' END || job_id AS source_url,
           coalesce(u.status, 'pendiente') AS status, 'order ' || u.k AS content_md, (u.k % 4)::INT AS tier, coalesce(u.k::VARCHAR, '0') AS n, 1 AS meta_keys
    FROM o FULL JOIN u USING (job_id)""")
def _upsert(spark, sf):
    merged = envelopes.upsert_envelopes(_stored(spark, sf), _updates(spark, sf))
    return merged.select(
        "job_id", "source_url", "status", "content_md", "tier", F.col("meta")["n"].alias("n"), F.size("meta").alias("meta_keys")
    )


@query("attach_embeddings", """
    SELECT c_custkey AS job_id, round(e.embedding[1]::DOUBLE, 6) AS first FROM customer LEFT JOIN embeddings e ON vec_id = c_custkey
    WHERE c_custkey % 3 <> 0""")
def _attach(spark, sf):
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "job_id")
    return envelopes.attach_embeddings(_stored(spark, sf), vectors).select(
        "job_id", F.round(F.get("embedding", 0).cast("double"), 6).alias("first")
    )


@query("public_view", "SELECT o_orderkey, 'k,n' AS kept FROM orders")
def _public(spark, sf):
    secret = F.create_map(
        F.lit("proxy"), F.lit("p"), F.lit("n"), F.col("o_orderkey").cast("string"), F.lit("cookies"), F.lit("c"),
        F.lit("k"), F.lit("v"), F.lit("owner_jti"), F.lit("j"), F.lit("callback_url"), F.lit("u"),
    )
    env = table(spark, sf, "orders", "o_orderkey").withColumn("meta", secret)
    return envelopes.public_view(env).select(
        "o_orderkey", F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("kept")
    )


@query("write_results", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'llms_txt' ELSE 'json' END AS output_format, text AS content_md FROM documents""")
def _write(spark, sf):
    names = F.array(F.lit("markdown"), F.lit("llms_txt"), F.lit("json"))
    done = table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.get(names, (F.col("doc_id") % 3).cast("int")).alias("output_format"), F.col("text").alias("content_md")
    )
    folder = _folder(spark)
    sinks.write_results(done, folder)
    return spark.read.parquet(folder)


@query("export_records", "SELECT p_partkey AS id, p_name AS title, p_brand || ', \"' || p_type || '\"' AS note FROM part")
def _export(spark, sf):
    records = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("note"),
    )
    folder = _folder(spark)
    sinks.export_records(records, folder, "csv")
    return spark.read.option("header", True).option("escape", '"').schema("id bigint, title string, note string").csv(folder)


@query("sql_functions", rf"""
    SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {HOST_SQL} AS host, {PATH_SQL} AS path,
           {QUERY_SQL} AS query, array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') AS domain,
           starts_with({PATH_SQL}, '/en/') AS in_section, page_id % 2 = 0 AS same, CASE WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'zip' END AS ext,
           CASE WHEN page_id % 3 = 0 THEN 'document' ELSE 'archive' END AS kind, page_id % 3 = 0 AS chrome, page_id % 3 = 1 AS telemetry,
           CASE WHEN page_id % 3 = 0 THEN 'youtube' END AS video, 'https://' || {HOST_SQL} || '/a' AS logged, page_id % 3 = 0 AS card, page_id % 3 <> 0 AS phone
    FROM pages""")
def _sql(spark, sf):
    sql_functions.register(spark)
    third = "CASE WHEN page_id % 3 = 0 THEN {} ELSE {} END".format
    return spark.sql(f"""
        SELECT page_id, wc_url_scheme(url) AS scheme, wc_url_host(url) AS host, wc_url_path(url) AS path, wc_url_query(url) AS query,
               wc_reg_domain(wc_url_host(url)) AS domain, wc_in_scope(url, '/en/') AS in_section,
               wc_same_domain(url, concat('https://', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'x.' END, upper(wc_url_host(url)), '/y')) AS same,
               wc_url_ext({third("'http://h/a.b/f.PDF?x=1.png'", "'/f.zip#a.b'")}) AS ext, wc_asset_kind({third("'pdf'", "'zip'")}) AS kind,
               wc_is_chrome({third("'http://h/login/x'", "'http://h/loginx'")}) AS chrome,
               wc_is_telemetry(CASE WHEN page_id % 3 = 1 THEN 'https://www.google-analytics.com/collect' ELSE url END) AS telemetry,
               wc_video_provider({third("'https://www.youtube.com/watch?v=1'", "url")}) AS video,
               wc_redact_url(concat('https://', wc_url_host(url), '/a?token=b#c')) AS logged,
               wc_luhn_ok({third("'4111111111111111'", "'4111111111111112'")}) AS card, wc_phone_ok({third("'12-34'", "'(011) 4444-5555'")}) AS phone
        FROM parquet.`{sf}/pages.parquet`""")


@query("sql_cosine", """
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity FROM embeddings""")
def _sql_cosine(spark, sf):
    sql_functions.register(spark)
    return spark.sql(f"SELECT vec_id, round(wc_cosine(embedding, reverse(embedding)), 6) AS similarity FROM parquet.`{sf}/embeddings.parquet`")


@query("sql_html_elements", rf"""
    WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all({MARKUP_SQL}, '<([a-zA-Z][a-zA-Z0-9]*)[\s/>]', 1))) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS elements FROM t GROUP BY ALL""")
def _sql_elements(spark, sf):
    sql_functions.register(spark)
    return spark.sql(f"""
        SELECT page_id, e.tag, count(*) AS elements FROM parquet.`{sf}/pages.parquet` p, LATERAL wc_html_elements(p.html) e
        WHERE e.tag NOT IN ('#text', 'script', 'style') GROUP BY 1, 2""")


@query("sql_table_functions", "SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS k FROM events")
def _udtf(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        f"SELECT e.event_id, n.scalar AS k FROM parquet.`{sf}/events.parquet` e, LATERAL wc_json_nodes(e.props) n WHERE n.key = 'k'"
    )
