"""End-to-end jobs over the shop site."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from webcorpus.operators import crawl, privacy
from webcorpus.plans import jobs
from webcorpus.plans.catalog import query, table
from webcorpus.plans.catalog.crawl import SITE, shop_pages
from webcorpus.plans.catalog.privacy import role_of
from webcorpus.session import cut_lineage, shared_dir
from webcorpus.sources.endpoints import read_endpoints


def gather_requests(spark, sf):
    """One request per customer with orders: single page, small crawl or paging sweep; a tenth miss."""
    kind = F.col("o_custkey") % 3
    missing = F.col("o_custkey") % 10 == 9
    return table(spark, sf, "orders", "o_custkey").distinct().select(
        F.col("o_custkey").alias("job_id"),
        F.concat(F.lit(SITE + "/c/"), F.when(missing, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))).alias("url"),
        F.when(kind == 1, 1).otherwise(0).alias("crawl_depth"), F.when(kind == 1, 5).otherwise(1).alias("max_pages"),
        (kind == 2).alias("paginate"), F.lit("domain").alias("crawl_scope"),
    )


@query("gather", f"""
    WITH o AS (SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS ord
               FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT DISTINCT o_custkey AS job_id, 1 AS ord, '{SITE}/c/' || o_custkey AS url FROM orders WHERE o_custkey % 10 <> 9
    UNION ALL SELECT job_id, ord, '{SITE}/o/' || o_orderkey FROM o WHERE ord <= 5 AND job_id % 3 = 1 AND job_id % 10 <> 9""")
def _gather(spark, sf):
    found, _ = jobs.gather(gather_requests(spark, sf), shop_pages(spark, sf))
    return found.select("job_id", "ord", "url")


@query("gather_errors", """
    SELECT DISTINCT o_custkey AS job_id, CASE WHEN o_custkey % 3 = 1 THEN 'the crawl brought no page' ELSE 'the page could not be fetched' END AS error
    FROM orders WHERE o_custkey % 10 = 9""")
def _gather_errors(spark, sf):
    _, errors = jobs.gather(gather_requests(spark, sf), shop_pages(spark, sf))
    return errors


_TEXT = "'# Customer ' || c_custkey || chr(10) || chr(10) || 'write to '"
_MAIL = "'u' || c_custkey || '@mail.example'"


@query("run_jobs", f"""
    WITH r AS (SELECT c_custkey, c_custkey % 3 AS role, c_custkey % 4 AS wish, c_custkey % 5 AS f FROM customer),
    m AS (SELECT *, CASE wish WHEN 0 THEN CASE role WHEN 2 THEN 'directo' ELSE 'opaco' END WHEN 1 THEN 'opaco'
                 WHEN 2 THEN CASE WHEN role > 0 THEN 'reversible' END ELSE CASE WHEN role = 2 THEN 'directo' END END AS mode FROM r),
    b AS (SELECT *, CASE WHEN mode IS NULL THEN 'the role does not allow this privacy mode' WHEN f = 4 THEN 'the page could not be fetched' END AS error,
                 {_TEXT} || CASE mode WHEN 'directo' THEN {_MAIL} ELSE '«EMAIL_1»' END AS body FROM m)
    SELECT c_custkey AS job_id, coalesce(mode, list_extract([NULL, 'opaco', 'reversible', 'directo'], CAST(wish + 1 AS INT))) AS privacy_mode,
        CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error,
        CASE WHEN error IS NULL AND f <> 3 THEN CASE WHEN f = 2 THEN '# Customer ' || c_custkey || chr(10) || chr(10) || '> Fuente: http://j.example/'
             || c_custkey || chr(10) || chr(10) || body || chr(10) ELSE body END END AS content_md,
        CASE WHEN error IS NULL AND f = 3 THEN '{{"mail": "' || CASE mode WHEN 'opaco' THEN '«EMAIL_1»' ELSE {_MAIL} END || '"}}' END AS content_json,
        error IS NULL AND mode <> 'directo' AS anonymised,
        CASE WHEN error IS NULL THEN '1' END AS pages,
        CASE WHEN error IS NULL THEN CASE WHEN mode = 'directo' THEN 'http://j.example/f/' || c_custkey || '.pdf' ELSE 'http://j.example/f/' || c_custkey || '.pdf' END END AS file
    FROM b""")
def _run(spark, sf):
    requests, corpus = customer_jobs(spark, sf)
    return _shown(jobs.run_jobs(requests, corpus, {"type": "object", "required": ["mail"]}, _complete))


def customer_jobs(spark, sf):
    """A job per customer, in all modes and formats, over a page per customer; a fifth of the pages is missing."""
    key = F.col("c_custkey").cast("string")
    customers = table(spark, sf, "customer", "c_custkey")
    fifth = F.col("c_custkey") % 5
    formats = F.array(*[F.lit(f) for f in ("markdown", "markdown", "llms_txt", "json", "markdown")])
    wishes = F.array(*[F.lit(m).cast("string") for m in (None, "opaco", "reversible", "directo")])
    url = F.concat(F.lit("http://j.example/"), key)
    requests = customers.select(
        F.col("c_custkey").alias("job_id"), url.alias("url"), role_of("c_custkey").alias("role"),
        F.get(wishes, (F.col("c_custkey") % 4).cast("int")).alias("privacy_mode"),
        F.get(formats, fifth.cast("int")).alias("output_format"), F.lit(0).alias("crawl_depth"), F.lit(1).alias("max_pages"),
        F.lit(False).alias("paginate"), F.lit("domain").alias("crawl_scope"),
    )
    html = F.concat(
        F.lit("<nav><a href='/'>home</a></nav><h1>Customer "), key, F.lit("</h1><p>write to u"), key,
        F.lit("@mail.example</p><footer><a href='/f/"), key, F.lit(".pdf'>file</a></footer>"),
    )
    corpus = customers.filter(fifth != 4).select(url.alias("url"), html.alias("html"))

    return requests, corpus


def _complete(systems, users):
    return ['{"mail": "%s"}' % user.split("write to ")[1].split("\n")[0] for user in users]


def _shown(done):
    file = F.get_json_object(F.col("meta")["files"], "$[0].url")
    return done.select(
        "job_id", "privacy_mode", "status", "error", "content_md", "content_json", "anonymised",
        F.col("meta")["pages"].alias("pages"), file.alias("file"),
    )


@query("revert_jobs", """
    SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 7 = 0 THEN 'wrong_owner' ELSE 'ok' END AS status,
           CASE WHEN c_custkey % 3 <> 2 OR c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 5 = 2 THEN '# Customer ' || c_custkey || chr(10) || chr(10) || '> Fuente: http://j.example/'
               || c_custkey || chr(10) || chr(10) ELSE '' END || '# Customer ' || c_custkey || chr(10) || chr(10) || 'write to u' || c_custkey || '@mail.example'
               || CASE WHEN c_custkey % 5 = 2 THEN chr(10) ELSE '' END END AS content
    FROM customer WHERE c_custkey % 4 = 2 AND c_custkey % 3 > 0 AND c_custkey % 5 < 3""")
def _revert_jobs(spark, sf):
    """Reversible jobs run, stored with their maps, read back and reverted; some are asked for by another role."""
    requests, corpus = customer_jobs(spark, sf)
    secret, run_at = "sixteen byte key", datetime(2024, 1, 1)
    envelopes, maps = jobs.run_reversible_jobs(requests, corpus, secret, run_at, with_files=False)
    base = f"{shared_dir(spark)}/job-store-{uuid.uuid4().hex}"
    jobs.store_version(base, 1, {"envelopes": envelopes, "maps": maps})
    done = jobs.stored_version(spark, base, "envelopes").filter("mapping_ref IS NOT NULL")
    other = (F.col("role") == F.lit("dios")) & (F.col("job_id") % 7 == 0)
    asked = done.select(
        F.col("job_id").alias("request_id"), F.lit(run_at).alias("asked_at"), F.col("mapping_ref").alias("ref"),
        F.when(other, "angel").otherwise(F.col("role")).alias("role"), F.col("content_md").alias("content"),
    )
    spent = spark.createDataFrame([], "ref string")
    answers, _ = privacy.revert(asked, jobs.stored_version(spark, base, "maps"), spent, secret, run_at)
    return answers.select(F.col("request_id").alias("job_id"), "status", "content")


def order_traffic(spark, sf):
    """Two data responses per order page: the larger one holds one record per line item."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda x: F.struct(F.concat(F.lit("Part "), x["l_partkey"]).alias("title"), x["l_partkey"].alias("sku")),
    )
    orders = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(
        F.to_json(F.struct(lines.alias("lines"), F.repeat(F.lit("x"), 200).alias("pad"))).alias("big")
    )
    key = F.col("l_orderkey").cast("string")
    seen = F.array(
        F.struct(F.lit(0).alias("seq"), F.concat(F.lit("http://api.shop.example/api/"), key).alias("url"), F.lit(200).alias("status"),
                 F.lit("application/json").alias("content_type"), F.lit('{"rows": [{"title": "small"}]}').alias("body")),
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit("http://cdn.example/"), key).alias("url"), F.lit(200).alias("status"),
                 F.lit("application/json").alias("content_type"), F.col("big").alias("body")),
    )
    return read_endpoints(orders.select(F.concat(F.lit(SITE + "/o/"), key).alias("page_url"), F.inline(seen)))


TREE_SQL = """
    o AS (SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS ord
          FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def shop_tree(spark, sf):
    seeds = table(spark, sf, "orders", "o_custkey").distinct().select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit(SITE + "/c/"), "o_custkey").alias("url")
    )
    # Room for the customer's page and all of the orders it links to.
    most = table(spark, sf, "orders", "o_custkey").groupBy("o_custkey").count().agg(F.max("count")).first()[0] or 0
    pages = cut_lineage(shop_pages(spark, sf))  # made of the tables once, for the crawl and for the texts
    return jobs.data_tree(pages, order_traffic(spark, sf), seeds, max_pages=most + 1)


@query("data_tree", f"""
    WITH {TREE_SQL}
    SELECT DISTINCT o_custkey AS job_id, 1 AS ord, '# Customer ' || o_custkey AS content_md, 0 AS endpoints_count, 0 AS records_count FROM orders
    UNION ALL SELECT job_id, ord, '# Order ' || o_orderkey, 2, n FROM o
        JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _tree(spark, sf):
    nodes, _ = shop_tree(spark, sf)
    return nodes.select("job_id", "ord", "content_md", "endpoints_count", "records_count")


@query("data_tree_records", f"""
    WITH {TREE_SQL} SELECT job_id, ord, 'Part ' || l_partkey AS title, l_partkey::VARCHAR AS id FROM o JOIN lineitem ON l_orderkey = o_orderkey""")
def _tree_records(spark, sf):
    _, found = shop_tree(spark, sf)
    return found.select("job_id", "ord", "title", "id")


@query("tree_summary", f"""
    WITH {TREE_SQL},
    lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    below AS (SELECT job_id, count(*) AS nodes, sum(n) AS records, sum(length('# Order ' || o_orderkey)) AS chars FROM o JOIN lines ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c AS job_id, 1 + coalesce(nodes, 0) AS nodes, coalesce(2 * nodes, 0)::BIGINT AS api_endpoints,
           (length('# Customer ' || c) + coalesce(chars, 0))::BIGINT AS markdown_total_chars, coalesce(records, 0)::BIGINT AS records, 1 AS roots
    FROM (SELECT DISTINCT o_custkey AS c FROM orders) LEFT JOIN below ON job_id = c""")
def _tree_summary(spark, sf):
    nodes, _ = shop_tree(spark, sf)
    return crawl.tree_summary(nodes)
