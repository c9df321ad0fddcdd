"""Fetch-log analytics with events standing in for attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webcorpus.operators import fetchlog
from webcorpus.plans.catalog import query, table

END = "2024-01-31 00:00:00"


def attempts(spark, sf):
    """Events as fetch attempts: an error is a block or a plain failure, all else succeeds."""
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id", F.floor(F.col("event_id") / 5).alias("fetch_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("domain"), F.col("user_id").alias("proxy"),
        (F.col("event_id") % 4).cast("int").alias("tier"),
        F.when(failed & (F.col("event_id") % 2 == 0), "blocked").when(failed, "error").otherwise("ok").alias("outcome"),
        F.when(failed, F.lit("status:403")).alias("signal"),
    )


@query("escalation_path", """
    SELECT event_id // 5 AS fetch_id, coalesce(string_agg(CASE WHEN event_type = 'error' THEN 't' || (event_id % 4) || ':' ||
        CASE WHEN event_id % 2 = 0 THEN 'status:403' ELSE 'error' END END, ' ' ORDER BY event_id), '') AS path FROM events GROUP BY 1""")
def _path(spark, sf):
    return fetchlog.escalation_path(attempts(spark, sf)).select("fetch_id", F.array_join("escalation", " ").alias("path"))


@query("winning_tier", f"""
    SELECT user_id AS domain, arg_max(event_id % 4, event_id)::INT AS tier FROM events
    WHERE event_type <> 'error' AND ts > TIMESTAMP '{END}' - INTERVAL 7 DAY GROUP BY 1""")
def _winner(spark, sf):
    return fetchlog.winning_tier(attempts(spark, sf), F.to_timestamp(F.lit(END)))


@query("start_tier", f"""
    WITH w AS (SELECT user_id AS domain, arg_max(event_id % 4, event_id)::INT AS tier FROM events
               WHERE event_type <> 'error' AND ts > TIMESTAMP '{END}' - INTERVAL 7 DAY GROUP BY 1)
    SELECT c_custkey, least(greatest(c_custkey % 3, coalesce(tier, 0)), 2)::INT AS start_tier
    FROM customer LEFT JOIN w ON c_custkey = domain""")
def _start(spark, sf):
    requests = table(spark, sf, "customer", "c_custkey").select(
        "c_custkey", F.col("c_custkey").alias("domain"), (F.col("c_custkey") % 3).cast("int").alias("tier_hint")
    )
    return fetchlog.cached_tier(attempts(spark, sf), requests, F.to_timestamp(F.lit(END)), 2).select("c_custkey", "start_tier")


@query("proxy_health", f"""
    WITH last_ok AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type <> 'error' GROUP BY 1),
    streak AS (SELECT e.user_id, count(*) AS fails, max(ts) AS failed_at FROM events e LEFT JOIN last_ok l USING (user_id)
               WHERE event_type = 'error' AND (l.e IS NULL OR event_id > l.e) GROUP BY 1)
    SELECT u.user_id AS proxy, u.attempts, coalesce(s.fails, 0) AS fails,
           floor(epoch(s.failed_at + INTERVAL (least(s.fails, 5) * 300000) SECOND))::BIGINT AS cooldown_s,
           coalesce(s.failed_at + INTERVAL (least(s.fails, 5) * 300000) SECOND <= TIMESTAMP '{END}', true) AS healthy
    FROM (SELECT user_id, count(*) AS attempts FROM events GROUP BY 1) u LEFT JOIN streak s USING (user_id)""")
def _health(spark, sf):
    health = fetchlog.proxy_health(attempts(spark, sf), F.to_timestamp(F.lit(END)), 300_000)
    return health.select(
        "proxy", "attempts", "fails", F.unix_seconds("cooldown_until").alias("cooldown_s"), "healthy"
    )


@query("counts_by_label", "SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def _counts(spark, sf):
    return fetchlog.counts_by(table(spark, sf, "events", "event_type"), "event_type")


@query("fetches_by_tier", "SELECT (event_id % 4)::VARCHAR AS tier, count(*) AS total FROM events WHERE event_type <> 'error' GROUP BY 1")
def _tiers(spark, sf):
    return fetchlog.counts_by(attempts(spark, sf).filter("outcome = 'ok'"), "tier")


@query("duration_histogram", """
    SELECT b.le, count(*) FILTER (WHERE value / 10 <= b.bound) AS observations FROM events,
        (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.075', 0.075), ('0.1', 0.1), ('0.25', 0.25),
                ('0.5', 0.5), ('0.75', 0.75), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('7.5', 7.5), ('10.0', 10.0),
                ('+Inf', 'inf'::DOUBLE)) AS b(le, bound) GROUP BY 1""")
def _histogram(spark, sf):
    return fetchlog.duration_histogram(table(spark, sf, "events", "value").select((F.col("value") / 10).alias("seconds")))


@query("five_minute_rate", """
    WITH m AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, epoch(minute + INTERVAL (i) MINUTE)::BIGINT AS window_end, round(sum(n) / 300.0, 6) AS rate
    FROM m, range(1, 6) AS r(i) GROUP BY ALL""")
def _rate(spark, sf):
    rates = fetchlog.five_minute_rate(table(spark, sf, "events", "event_type", "ts"), "event_type")
    return rates.select(
        "event_type", F.unix_timestamp("window_end").alias("window_end"), F.round("rate", 6).alias("rate")
    )


@query("queue_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS depth, count(*) AS seen FROM orders")
def _queue(spark, sf):
    return fetchlog.queue_counts(table(spark, sf, "orders", "o_orderstatus"), "o_orderstatus", "P")


@query("last_steps", """
    SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    WHERE r <= 60""")
def _steps(spark, sf):
    return fetchlog.last_steps(table(spark, sf, "events", "user_id", "event_id"), 60, "user_id", "event_id")


@query("rate_limit", """
    WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, n, n <= 3 AS allowed FROM n""")
def _limit(spark, sf):
    limited = fetchlog.rate_limit(
        table(spark, sf, "events", "event_id", "ts", "event_type"), 3, 3600, "event_type", "ts", "event_id"
    )
    return limited.select("event_id", "n", "allowed")
