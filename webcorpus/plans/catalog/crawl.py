"""Traversal and graph operators over a site built from customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webcorpus.operators import crawl, robots
from webcorpus.plans.catalog import query, table
from webcorpus.session import cut_lineage

SITE = "http://shop.example"


def shop_pages(spark, sf):
    """Customer pages link to their orders, order pages to their parts; parts of a brand look alike."""

    def anchors(path, key, *order):
        """The anchors of a page; keys travel, tags are put around them where they have met."""
        listed = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, key]))))
        return F.array_join(F.transform(listed, lambda x: F.concat(F.lit(f'<a href="/{path}/'), x[key], F.lit('">x</a>'))), " ")

    customers = table(spark, sf, "orders", "o_custkey", "o_orderkey").groupBy("o_custkey").agg(
        anchors("o", "o_orderkey").alias("body")
    ).select(
        F.concat(F.lit(SITE + "/c/"), "o_custkey").alias("url"),
        F.concat(F.lit("<h1>Customer "), "o_custkey", F.lit("</h1>"), "body").alias("html"),
    )
    orders = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(
        anchors("p", "l_partkey", "l_linenumber").alias("body")
    ).select(
        F.concat(F.lit(SITE + "/o/"), "l_orderkey").alias("url"),
        F.concat(F.lit("<h1>Order "), "l_orderkey", F.lit("</h1>"), "body").alias("html"),
    )
    parts = table(spark, sf, "part", "p_partkey", "p_brand").select(
        F.concat(F.lit(SITE + "/p/"), "p_partkey").alias("url"),
        F.concat(F.lit("<p>"), "p_brand", F.lit("</p>")).alias("html"),
    )
    return customers.unionByName(orders).unionByName(parts)


def shop_seeds(spark, sf):
    return table(spark, sf, "orders", "o_custkey").distinct().select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit(SITE + "/c/"), "o_custkey").alias("url")
    )


CRAWL_SQL = f"""
    lvl1 AS (SELECT o_custkey AS job_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
             FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    lvl2 AS (SELECT job_id, l_partkey, min((n, l_linenumber, l_partkey)) AS place, arg_min(o_orderkey, (n, l_linenumber, l_partkey)) AS parent
             FROM lvl1 JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 29 GROUP BY ALL),
    brands AS (SELECT job_id, p_brand, min(place) AS place, arg_min(l_partkey, place) AS l_partkey, arg_min(parent, place) AS parent
               FROM lvl2 JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    nodes AS (
      SELECT DISTINCT o_custkey AS job_id, 0 AS depth, 0 AS k, '{SITE}/c/' || o_custkey AS url, NULL AS parent FROM orders
      UNION ALL SELECT job_id, 1, n, '{SITE}/o/' || o_orderkey, '{SITE}/c/' || job_id FROM lvl1
      UNION ALL SELECT job_id, 2, row_number() OVER (PARTITION BY job_id ORDER BY place), '{SITE}/p/' || l_partkey, '{SITE}/o/' || parent FROM brands),
    crawled AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY depth, k) AS ord FROM nodes) WHERE ord <= 30)"""


def crawled_shop(spark, sf, pages=None):
    return crawl.crawl(shop_pages(spark, sf) if pages is None else pages, shop_seeds(spark, sf), max_pages=30, max_depth=2)


@query("crawl", f"WITH {CRAWL_SQL} SELECT job_id, ord, url, depth, parent FROM crawled")
def _crawl(spark, sf):
    return crawled_shop(spark, sf)


@query("page_tree", f"""
    WITH {CRAWL_SQL},
    kids AS (SELECT job_id, parent AS url, count(*) AS children FROM crawled WHERE parent IS NOT NULL GROUP BY ALL)
    SELECT c.job_id, c.url, coalesce(children, 0) AS children, c.depth + 1 AS path_length,
           CASE c.depth WHEN 0 THEN 'Customer ' || c.job_id END AS title
    FROM crawled c LEFT JOIN kids USING (job_id, url)""")
def _tree(spark, sf):
    stored = cut_lineage(shop_pages(spark, sf))  # made of the tables once, for the crawl and for the tree
    pages = stored.withColumn(
        "text", F.regexp_replace(F.regexp_replace("html", "<h1>(Customer \\d+)</h1>", "# $1\n"), "<[^>]+>", "")
    )
    tree = crawl.page_tree(crawled_shop(spark, sf, stored), pages, max_depth=2)
    return tree.select("job_id", "url", "children", F.size("path").alias("path_length"), "title")


@query("dedup_content", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _dedup(spark, sf):
    return crawl.dedup_content(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", ["doc_id"])


@query("robots_allowed", """
    WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey AS s, l_partkey % 50 AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, s, p, CASE WHEN s % 4 = 0 THEN p = 15 OR NOT (p = 7 OR p = 1 OR p BETWEEN 10 AND 19)
        WHEN s % 4 = 1 THEN p = 2 OR p BETWEEN 20 AND 29 WHEN s % 4 = 2 THEN true ELSE false END AS robots_ok FROM u""")
def _robots(spark, sf):
    kind = F.col("s_suppkey") % 4
    body = (
        F.when(kind == 0, F.lit("User-agent: *\nAllow: /p/15\nDisallow: /p/7/\nDisallow: /p/1 # teens\nUser-agent: x\nAllow: /"))
        .when(kind == 1, F.lit("User-agent: *\nDisallow:\n\nUser-agent: webcorpus\nAllow: /p/2\nDisallow: /\n"))
        .when(kind == 3, F.lit("User-agent: *\nDisallow: /\n"))
    )
    files = table(spark, sf, "supplier", "s_suppkey").select(
        F.concat(F.lit("http://s"), "s_suppkey", F.lit(".example")).alias("origin"),
        body.alias("body"),
    )
    part = F.col("l_partkey") % 50
    urls = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"), part.alias("p"),
        F.concat(F.lit("http://s"), "l_suppkey", F.lit(".example/p/"), part, F.lit("/")).alias("url"),
    )
    return robots.robots_allowed(urls, robots.robots_rules(files), "webcorpus").drop("url")


@query("frontier_dedup", """
    SELECT l_suppkey AS crawl_id, l_partkey AS url, min(l_orderkey * 1000 + l_linenumber * 10 + l_partkey % 10) AS seq FROM lineitem
    WHERE NOT (l_suppkey % 2 = 0 AND l_partkey % 3 = 0) GROUP BY ALL""")
def _frontier(spark, sf):
    pushes = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").select(
        F.col("l_suppkey").alias("crawl_id"), F.col("l_partkey").alias("url"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("seq"),
        F.lit(0).alias("depth"),
    )
    visited = pushes.filter((F.col("crawl_id") % 2 == 0) & (F.col("url") % 3 == 0)).select("crawl_id", "url").distinct()
    return crawl.frontier_dedup(pushes, visited).select("crawl_id", "url", "seq")


@query("frontier_counts", """
    SELECT l_suppkey AS crawl_id, count(DISTINCT l_partkey) AS visited,
           count(DISTINCT CASE WHEN l_partkey % 2 = 1 THEN l_partkey END) AS pending FROM lineitem GROUP BY 1""")
def _frontier_counts(spark, sf):
    queued = table(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(
        F.col("l_suppkey").alias("crawl_id"), F.col("l_partkey").alias("url")
    ).distinct()
    return crawl.frontier_counts(queued, queued.filter(F.col("url") % 2 == 0))


def fetched_orders(spark, sf):
    """Orders as fetched pages of their customer's job."""
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders", "o_custkey", "o_orderkey").select(
        F.col("o_custkey").alias("job_id"), turn.alias("ord"), F.concat(F.lit("http://o/"), "o_orderkey").alias("url"),
        F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"),
        (F.col("o_orderkey") % 4).cast("int").alias("tier"), F.lit("static").alias("tier_name"),
        F.array().cast("array<string>").alias("escalation"),
        F.when(F.col("o_orderkey") % 2 == 0, "http://proxy").alias("proxy"), F.col("o_orderkey").alias("bytes"),
    )


@query("job_summary", """
    SELECT o_custkey AS job_id, 'http://o/' || min(o_orderkey) AS final_url, 200 AS http_status, sum(o_orderkey)::BIGINT AS bytes,
           count(*) AS pages, (min(o_orderkey) % 4)::INT AS tier, min(o_orderkey) % 2 = 0 AS proxied FROM orders GROUP BY 1""")
def _job_summary(spark, sf):
    return crawl.job_summary(fetched_orders(spark, sf)).select(
        "job_id", "final_url", "http_status", "bytes", "pages", "tier", "proxied"
    )
