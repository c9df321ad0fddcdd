"""Streams run over stored tables to their end; each has a batch twin in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.plans.catalog import query, table
from webcorpus.session import shared_dir
from webcorpus.streaming import state, streams

HOUR = 3600
SLOTS = 512  # groups of keys with one state value each
WINDOW_SLOTS = 16  # the same in each window


def stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def in_steps(rows: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "append", steps: int = 3) -> DataFrame:
    """What a stream writes that gets a table in steps of its event time, each run to its end from the last checkpoint."""
    spark, base = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/steps-{uuid.uuid4().hex}"
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(micros), F.max(micros)).first()
    step = F.least(F.floor((micros - F.lit(first)) * steps / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(steps - 1))
    for number in range(steps):
        rows.filter(step == number).write.mode("append").parquet(f"{base}/in")
        out = streams.run_available(make(spark.readStream.schema(rows.schema).parquet(f"{base}/in")), mode, f"{base}/run")
    return out


#: A value written at ``ts`` is gone when the last watermark, ten minutes before the newest row, has reached its expiry.
_LIVES = "epoch_ms(max(ts)) + {} > (SELECT epoch_ms(max(ts)) - 600000 FROM events{})"


@query("stream_rate_limit", f"""
    WITH n AS (SELECT user_id::VARCHAR AS key, floor(epoch(ts) / {HOUR})::BIGINT AS bucket, count(*) AS attempts FROM events GROUP BY ALL)
    SELECT key, bucket, attempts, least(attempts, 2) AS allowed FROM n""")
def _limit(spark, sf):
    attempts = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    out = in_steps(attempts, lambda rows: state.stream_rate_limit(rows, 2, HOUR, slots=WINDOW_SLOTS))
    return out.groupBy("key", "bucket").agg(
        F.count("*").alias("attempts"), F.sum(F.col("allowed").cast("int")).alias("allowed")
    )


@query("stream_latest_envelope", f"""
    SELECT user_id::VARCHAR AS job_id, arg_max(props, (ts, event_id)) AS envelope, 86400000000 AS lifetime FROM events GROUP BY 1
    HAVING {_LIVES.format(24 * HOUR * 1000, "")}""")
def _latest(spark, sf):
    updates = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("envelope")
    )
    newest = state.current(in_steps(updates, state.stream_latest_envelope, "update"))
    return newest.select(
        F.col("key").alias("job_id"), F.col("payload").alias("envelope"), (F.col("expires") - F.col("at")).alias("lifetime"),
    )


_WINS = " WHERE event_type <> 'error'"


@query("stream_tier_cache", f"""
    SELECT user_id::VARCHAR AS domain, arg_max(event_id % 4, (ts, event_id))::VARCHAR AS tier FROM events{_WINS} GROUP BY 1
    HAVING {_LIVES.format(7 * 24 * HOUR * 1000, "")}""")
def _tiers(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("domain"), "ts", F.col("event_id").alias("seq"),
        (F.col("event_id") % 4).cast("int").alias("tier"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
    )
    return state.current(in_steps(attempts, state.stream_tier_cache, "update")).select(F.col("key").alias("domain"), F.col("payload").alias("tier"))


@query("stream_frontier", "SELECT DISTINCT event_type AS crawl_id, user_id AS url FROM events")
def _frontier(spark, sf):
    pushes = stream(spark, sf, "events").select(F.col("event_type").alias("crawl_id"), F.col("user_id").alias("url"))
    return streams.run_available(streams.stream_frontier(pushes)).select("crawl_id", "url")


@query("stream_mask", "SELECT o_orderkey, 'order «EMAIL_1»' AS masked, 1 AS entities FROM orders")
def _mask(spark, sf):
    notes = stream(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("order u"), "o_custkey", F.lit("@mail.example")).alias("text")
    )
    out = streams.run_available(streams.stream_mask(notes))
    return out.select("o_orderkey", "masked", "entities")


@query("stream_jobs_to_table", """
    SELECT o_custkey AS job_id, 'order «EMAIL_1»' AS content_md, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def _jobs(spark, sf):
    done = stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit("order o"), "o_orderkey", F.lit("@mail.example")).alias("content_md"),
        F.col("o_orderstatus").alias("status"), "o_orderkey",
    )
    return streams.stream_jobs_to_table(done, f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}", ["o_orderkey"])


@query("stream_metrics", """
    SELECT event_type, epoch(date_trunc('minute', ts) + INTERVAL (i) MINUTE)::BIGINT AS window_end, count(*) AS n,
           round(count(*) / 300.0, 6) AS rate FROM events, range(1, 6) AS r(i) GROUP BY ALL""")
def _metrics(spark, sf):
    rows = stream(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.run_available(streams.stream_metrics(rows, "event_type"), "update")
    latest = out.groupBy("event_type", "window_end").agg(F.max("n").alias("n"))
    return latest.select(
        "event_type", F.unix_timestamp("window_end").alias("window_end"), "n", F.round(F.col("n") / 300.0, 6).alias("rate")
    )


@query("stream_token_maps", """
    SELECT 'r' || o_orderkey AS ref, o_orderkey * 10 + n AS seq, CASE
        WHEN n = 1 THEN 'role_not_allowed' WHEN o_orderkey % 5 = 0 THEN 'gone'
        WHEN n = 2 AND o_orderkey % 2 = 0 THEN 'wrong_owner' WHEN n = 2 THEN 'ok' ELSE 'gone' END AS status
    FROM orders, (VALUES (1), (2), (3)) AS t(n) WHERE n <> 2 OR o_orderkey % 3 <> 0""")
def _maps(spark, sf):
    """Stored at once, asked for after one, two and thirty hours; a map lives for a day, every fifth for half an hour.

    Every third map is not asked for in time, so that only its timer ends it.
    """
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    n = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n")
    entries = table(spark, sf, "orders").select("o_orderkey", n).filter((F.col("n") != 2) | (F.col("o_orderkey") % 3 != 0)).select(
        F.concat(F.lit("r"), "o_orderkey").alias("ref"), F.when(F.col("n") == 0, "put").otherwise("get").alias("kind"),
        (start + F.make_dt_interval(hours=F.when(F.col("n") == 3, 30).otherwise(F.col("n")))).alias("ts"), (F.col("o_orderkey") * 10 + F.col("n")).alias("seq"),
        F.when(F.col("n") == 1, "humano").when((F.col("n") == 2) & (F.col("o_orderkey") % 2 == 0), "dios").otherwise("angel").alias("role"),
        F.when(F.col("n") == 0, start + F.when(F.col("o_orderkey") % 5 == 0, F.make_dt_interval(mins=F.lit(30))).otherwise(F.make_dt_interval(days=F.lit(1)))).alias("expires_at"),
    )
    return in_steps(entries, lambda rows: state.stream_token_maps(rows, slots=SLOTS))
