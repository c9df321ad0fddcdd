"""Fetch-log analytics, counters and rates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.functions.urls import _col
from webcorpus.operators.ranking import sliced_row_number

DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
TIER_TTL_S = 7 * 24 * 3600


def escalation_path(attempts: DataFrame) -> DataFrame:
    """Per fetch the failed attempts in order as ``t<tier>:<signal>``; none gives an empty list.

    A fetch tries a handful of tiers and proxies, which bounds its list.
    """
    failed = F.when(
        F.col("outcome") != "ok",
        F.struct(
            "seq",
            F.concat(
                F.lit("t"), F.col("tier").cast("string"), F.lit(":"),
                F.when(F.col("outcome") == "error", F.lit("error")).otherwise(F.col("signal")),
            ).alias("step"),
        ),
    )
    return attempts.groupBy("fetch_id").agg(
        F.transform(F.array_sort(F.collect_list(failed)), lambda s: s["step"]).alias("escalation")
    )


def winning_tier(attempts: DataFrame, now: Column | datetime, ttl_s: int = TIER_TTL_S) -> DataFrame:
    """Tier of the latest success per domain within the time to live."""
    moment = now if isinstance(now, Column) else F.lit(now)
    live = attempts.filter(
        (F.col("outcome") == "ok") & (F.col("ts") > moment - F.make_dt_interval(secs=F.lit(ttl_s)))
    )
    return live.groupBy("domain").agg(F.max_by("tier", F.struct("ts", "seq")).alias("tier"))


def proxy_health(attempts: DataFrame, now: Column | datetime, cooldown_s: int = 300) -> DataFrame:
    """Failures since the last success per proxy and the cooldown they earn (at most five-fold)."""
    moment = now if isinstance(now, Column) else F.lit(now)
    at = F.struct("ts", "seq")
    summary = attempts.groupBy("proxy").agg(
        F.max(F.when(F.col("outcome") == "ok", at)).alias("last_ok"), F.count("*").alias("attempts")
    )
    streak = (
        attempts.filter(F.col("outcome") != "ok")
        .join(summary.select("proxy", "last_ok"), "proxy")
        .filter(F.col("last_ok").isNull() | (at > F.col("last_ok")))
        .groupBy("proxy")
        .agg(F.count("*").alias("fails"), F.max("ts").alias("failed_at"))
    )
    until = F.col("failed_at") + F.make_dt_interval(
        secs=F.least(F.col("fails"), F.lit(5)) * F.lit(cooldown_s)
    )
    return summary.join(streak, "proxy", "left").select(
        "proxy", "attempts", F.coalesce("fails", F.lit(0)).alias("fails"),
        until.alias("cooldown_until"), F.coalesce(until <= moment, F.lit(True)).alias("healthy"),
    )


def counts_by(rows: DataFrame, label: str, name: str = "total") -> DataFrame:
    """Counter per label: jobs by status, fetches by tier, challenges by vendor."""
    return rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("none")).alias(label)).agg(
        F.count("*").alias(name)
    )


def duration_histogram(
    rows: DataFrame, seconds: str = "seconds", buckets: tuple[float, ...] = DURATION_BUCKETS
) -> DataFrame:
    """Cumulative counts per upper bound, in one pass without a window."""
    bounds = [*buckets, float("inf")]
    totals = rows.agg(
        *[F.sum(F.when(F.col(seconds) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    )
    cells = [
        F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"),
                 F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("observations"))
        for i, b in enumerate(bounds)
    ]
    return totals.select(F.inline(F.array(*cells)))


def five_minute_rate(rows: DataFrame, label: str, ts: str = "ts") -> DataFrame:
    """Events per second over the five minutes up to each minute mark, per label.

    Rows shrink to one count per label and minute before any of them is copied into the
    five windows it belongs to.
    """
    minute = F.date_trunc("minute", F.col(ts).cast("timestamp"))
    per_minute = rows.groupBy(label, minute.alias("minute")).agg(F.count("*").alias("n"))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(5)), lambda m: F.col("minute") + F.make_dt_interval(mins=m)
    )
    return (
        per_minute.withColumn("window_end", F.explode(ends))
        .groupBy(label, "window_end")
        .agg((F.sum("n") / 300.0).alias("rate"))
    )


def queue_counts(queued: DataFrame, status: str = "status", pending: str = "pendiente") -> DataFrame:
    """Depth of the job queue and jobs seen."""
    return queued.agg(
        F.sum(F.when(F.col(status) == pending, 1).otherwise(0)).alias("depth"), F.count("*").alias("seen")
    )


def last_steps(steps: DataFrame, keep: int = 60, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """The last ``keep`` progress steps per job; Spark trims each job before the shuffle."""
    order = Window.partitionBy(job).orderBy(F.col(seq).desc())
    return steps.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= keep).drop("_back")


def rate_limit(
    attempts: DataFrame, limit: int, window_s: int = 60, key: str = "key", ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Add ``n``, the attempt's number in its fixed window, and ``allowed``.

    Denied attempts count as well. A limit of zero or less allows everything. Windows are
    cut into seconds, so one busy key spreads over many tasks.
    """
    epoch = F.unix_micros(F.col(ts).cast("timestamp"))
    windowed = attempts.withColumn("bucket", F.floor(epoch / (window_s * 1_000_000)))
    numbered = sliced_row_number(
        windowed, [key, "bucket"], F.floor(epoch / 1_000_000), [F.col(ts), F.col(seq)]
    )
    return numbered.withColumn("allowed", (F.col("n") <= limit) if limit > 0 else F.lit(True))


def cached_tier(attempts: DataFrame, requests: DataFrame, now: Column | datetime, cap: int) -> DataFrame:
    """Requests (domain, tier_hint) with the tier they should start at."""
    from webcorpus.functions.responses import start_tier

    cached = winning_tier(attempts, now).withColumnRenamed("tier", "cached_tier")
    return requests.join(cached, "domain", "left").withColumn(
        "start_tier", start_tier(_col("tier_hint"), "cached_tier", cap)
    )
