"""JSON operators over event properties and over documents built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from webcorpus.operators import comments, json_nodes, records
from webcorpus.plans.catalog import query, table
from webcorpus.sources.endpoints import read_endpoints


@query("json_nodes", """
    SELECT event_id AS doc, 0 AS node, NULL AS key, 'object' AS type, NULL AS scalar, length(props) AS json_len, '' AS pointer FROM events
    UNION ALL SELECT event_id, 1, 'k', 'number', regexp_extract(props, '(\\d+)', 1), length(regexp_extract(props, '(\\d+)', 1)), '/k' FROM events""")
def _nodes(spark, sf):
    docs = table(spark, sf, "events", "event_id", "props").withColumnRenamed("event_id", "doc")
    return json_nodes.json_nodes(docs, "props", ("node", "key", "type", "scalar", "json_len", "pointer"))


def listing_documents(spark, sf):
    """A search answer per customer: settings, a short list of tags, the orders as results.

    An order's title sits one level down, its price two, and every link has a fragment.
    """
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    item = F.struct(
        F.struct(F.col("o_orderpriority").alias("text"), F.lit("x").alias("lang")).alias("Title"),
        F.struct(F.struct(F.floor("o_totalprice").alias("amount")).alias("current_price")).alias("offer"),
        F.concat(F.lit("http://o.example/"), "o_orderkey", F.lit("#track")).alias("permalink"),
        F.col("o_orderkey").alias("id"),
        F.array(F.struct(F.lit("n").alias("name")), F.struct(F.lit("m").alias("name"))).alias("tags"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), item.alias("item")))), lambda x: x["item"]
    )
    body = F.to_json(
        F.struct(
            F.struct(F.lit(True).alias("ok"), F.lit("site").alias("name")).alias("settings"),
            F.array(F.struct(F.lit("a").alias("tag")), F.struct(F.lit("b").alias("tag"))).alias("filters"),
            listed.alias("results"), F.count("*").alias("total"),
        )
    )
    return orders.groupBy(F.col("o_custkey").alias("doc")).agg(body.alias("body"))


@query("count_items", """
    SELECT o_custkey AS doc, 4 + 2 + 2 + 2 + count(*) * (1 + 5 + 2 + 1 + 1 + 2 + 2) AS items FROM orders GROUP BY 1""")
def _count(spark, sf):
    return json_nodes.count_items(listing_documents(spark, sf))


@query("richest_array", """
    SELECT o_custkey AS doc, sum(length('{"Title": {"text": "' || o_orderpriority || '", "lang": "x"}, "offer": {"current_price": {"amount": '
        || floor(o_totalprice)::BIGINT || '}}, "permalink": "http://o.example/' || o_orderkey || '#track", "id": ' || o_orderkey
        || ', "tags": [{"name": "n"}, {"name": "m"}]}'))::BIGINT AS score, 1 AS array_depth
    FROM orders GROUP BY 1""")
def _richest(spark, sf):
    return records.richest_array(listing_documents(spark, sf)).select("doc", "score", "array_depth")


_RECORD_SQL = """SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS record,
    o_orderpriority AS title, floor(o_totalprice)::BIGINT::VARCHAR AS price, 'http://o.example/' || o_orderkey AS url,
    o_orderkey::VARCHAR AS id FROM orders"""


@query("flatten_records", _RECORD_SQL)
def _flatten(spark, sf):
    return records.flatten_records(listing_documents(spark, sf)).select("doc", "record", "title", "price", "url", "id")


@query("best_field", """
    SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS record, field,
        CASE field WHEN 'url' THEN 'string' WHEN 'id' THEN 'number' ELSE 'object' END AS node_type,
        CASE field WHEN 'url' THEN 'http://o.example/' || o_orderkey || '#track' WHEN 'id' THEN o_orderkey::VARCHAR END AS node_scalar
    FROM orders, (VALUES ('title'), ('price'), ('url'), ('id')) AS f(field)""".replace(
        "PARTITION BY o_custkey ORDER", "PARTITION BY o_custkey, field ORDER"))
def _best(spark, sf):
    return records.best_fields(listing_documents(spark, sf))


def captured_traffic(spark, sf):
    """What a browser saw on each customer's page: four responses, one of them tracking."""
    docs = listing_documents(spark, sf)
    page = F.concat(F.lit("http://www.shop.example/c/"), "doc")

    def response(seq, url, kind, body):
        return F.struct(
            F.lit(seq).alias("seq"), url.alias("url"), F.lit(200).alias("status"), F.lit(kind).alias("content_type"),
            body.alias("body"),
        )

    key = F.col("doc").cast("string")
    seen = F.array(
        response(0, F.concat(F.lit("https://www.google-analytics.com/collect?c="), key), "application/json", F.lit('{"a": 1}')),
        response(1, F.concat(F.lit("https://cdn.other.example.org/cfg/"), key), "application/json", F.lit('{"theme": "dark"}')),
        response(2, F.concat(F.lit("http://api.shop.example/api/list/"), key), "application/json", F.col("body")),
        response(3, F.concat(F.lit("http://www.shop.example/x/"), key, F.lit(".json")), "text/plain", F.lit("not json")),
        response(4, F.concat(F.lit("https://cdn.other.example.org/cfg/"), key), "application/json", F.lit('{"theme": "later"}')),
        response(5, F.concat(F.lit("http://www.shop.example/c/"), key), "text/html", F.lit("<p>")),
    )
    return docs.select(page.alias("page_url"), F.inline(seen))


_CUSTOMERS_WITH_ORDERS = "(SELECT DISTINCT o_custkey AS c FROM orders)"


@query("read_endpoints", f"""
    SELECT 'http://www.shop.example/c/' || c AS page_url, seq, is_json FROM {_CUSTOMERS_WITH_ORDERS},
        (VALUES (1, true), (2, true), (3, false)) AS t(seq, is_json)""")
def _endpoints(spark, sf):
    return read_endpoints(captured_traffic(spark, sf)).select("page_url", "seq", "is_json")


@query("score_endpoints", """
    WITH d AS (SELECT o_custkey AS c, sum(length('{"Title":{"text":"' || o_orderpriority || '","lang":"x"},"offer":{"current_price":{"amount":'
            || floor(o_totalprice)::BIGINT || '}},"permalink":"http://o.example/' || o_orderkey || '#track","id":' || o_orderkey
            || ',"tags":[{"name":"n"},{"name":"m"}]}')) + count(*) - 1 + length(count(*)::VARCHAR)
            + length('{"settings":{"ok":true,"name":"site"},"filters":[{"tag":"a"},{"tag":"b"}],"results":[],"total":}') AS bytes,
            10 + count(*) * 14 AS items FROM orders GROUP BY 1)
    SELECT 'http://www.shop.example/c/' || c AS page_url, seq, CASE seq WHEN 1 THEN 17 + 150 WHEN 2 THEN bytes + items * 150 + 12000 ELSE 0 END::BIGINT AS data_score
    FROM d, (VALUES (1), (2), (3)) AS t(seq)""")
def _score(spark, sf):
    return json_nodes.score_endpoints(read_endpoints(captured_traffic(spark, sf))).select("page_url", "seq", "data_score")


@query("rank_endpoints", f"""
    SELECT 'http://www.shop.example/c/' || c AS page_url, seq, rank FROM {_CUSTOMERS_WITH_ORDERS},
        (VALUES (2, 1), (1, 2)) AS t(seq, rank)""")
def _rank(spark, sf):
    scored = json_nodes.score_endpoints(read_endpoints(captured_traffic(spark, sf)))
    return json_nodes.rank_endpoints(scored, 2).select("page_url", "seq", "rank")


@query("capture_records", f"""
    WITH r AS ({_RECORD_SQL}) SELECT 'http://www.shop.example/c/' || doc AS page_url, record, title, price, url, id FROM r""")
def _capture(spark, sf):
    found, _ = records.capture_records(read_endpoints(captured_traffic(spark, sf)))
    return found.select("page_url", "record", "title", "price", "url", "id")


@query("capture_status", """
    WITH o AS (SELECT DISTINCT o_custkey FROM orders)
    SELECT c_custkey AS job_id, CASE WHEN o_custkey IS NULL THEN 0 ELSE 3 END AS api_endpoints,
        CASE WHEN o_custkey IS NOT NULL THEN 'http://api.shop.example/api/list/' || c_custkey END AS first_url,
        CASE WHEN o_custkey IS NULL THEN 'error' ELSE 'ok' END AS status FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def _capture_status(spark, sf):
    _, summary = records.capture_records(read_endpoints(captured_traffic(spark, sf)))
    jobs = table(spark, sf, "customer", "c_custkey").select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("http://www.shop.example/c/"), "c_custkey").alias("page_url")
    )
    return records.capture_status(jobs, summary).select(
        "job_id", "api_endpoints", F.get("api_urls", 0).alias("first_url"), "status"
    )


@query("flatten_comments", """
    WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text <> ''),
    pairs AS (SELECT conv_id, n * 2 AS o, 'user' || turn AS author, text, turn AS score, 1700000000 + turn AS created FROM t
             UNION ALL SELECT conv_id, n * 2 + 1, 'bot', 're ' || turn, 0, NULL FROM t)
    SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS rank, author, text, score, created FROM pairs""")
def _comments(spark, sf):
    def comment(author, body, score, created, replies):
        return F.struct(
            F.lit("t1").alias("kind"),
            F.struct(author.alias("author"), body.alias("body"), score.alias("score"), created.alias("created_utc"),
                     replies.alias("replies")).alias("data"),
        )

    nothing = F.lit(None).cast("string")
    reply = comment(F.lit("bot"), F.concat(F.lit("re "), "turn"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), nothing)
    more = F.struct(F.struct(F.array(reply).alias("children")).alias("data"))
    top = comment(
        F.concat(F.lit("user"), "turn"), F.col("text"), F.col("turn"), F.lit(1700000000) + F.col("turn"),
        more,
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", F.to_json(top).alias("c")))), lambda x: x["c"]
    )
    body = F.concat(
        F.lit('[{"data": {"children": []}}, {"data": {"children": ['), F.array_join(listed, ", "), F.lit("]}}]")
    )
    threads = table(spark, sf, "conversations", "conv_id", "turn", "text").groupBy(F.col("conv_id").alias("doc")).agg(
        body.alias("body")
    )
    found = comments.flatten_comments(threads)
    return found.select("doc", "rank", "author", "text", "score", F.unix_timestamp("created_at").alias("created"))


@query("normalize_comments", """
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'id' || conv_id END AS author, text, turn % 5 AS likes,
           CASE WHEN turn % 3 > 0 THEN 1700000000 + turn END AS created FROM conversations""")
def _normal(spark, sf):
    exported = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit("")).alias("author"),
        F.concat(F.lit("id"), "conv_id").alias("author_id"), "text", (F.col("turn") % 5).alias("like_count"),
        F.when(F.col("turn") % 3 > 0, F.lit(1700000000) + F.col("turn")).otherwise(F.lit(0)).alias("timestamp"),
    )
    return comments.normalize_comments(exported, "youtube").select(
        "conv_id", "turn", "author", "text", "likes", F.unix_timestamp("created_at").alias("created")
    )


@query("normalize_follows", """
    SELECT c_custkey, c_name AS username, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS full_name,
           c_custkey % 3 = 0 AS private, c_acctbal > 5000 AS verified FROM customer""")
def _follows(spark, sf):
    exported = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("username"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("full_name"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).alias("is_private"), (F.col("c_acctbal") > 5000).alias("is_verified"),
    )
    return comments.normalize_follows(exported)
