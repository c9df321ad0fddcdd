"""Keyed state over unbounded streams, cleared when it expires.

Each processor folds the chunks of a key's rows, so a busy key is never held whole. A call for a group of
rows costs milliseconds however few they are, so where keys are many and their rows few, ``slots`` deals the
keys into so many groups that share one state value. Time is event time: a value that expires sets a timer, and when the watermark passes it the state goes, whether
or not the key is heard of again. Rows later than the watermark are dropped, so a replay gives the same
answers as a batch run under the same rule, and ``availableNow`` ends by itself. RocksDB must be the
state store (see ``session``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webcorpus.operators.policy import reversible_roles

ENVELOPE_TTL_S = 24 * 3600
TIER_TTL_S = 7 * 24 * 3600
LATE_AFTER = "10 minutes"  # rows this much older than the newest are late; this library's choice
HELD_ROWS = 65_536  # attempts of a group that are put in order at once


def _watermarked(rows: DataFrame, late_after: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late_after)


def _slot(key: str, slots: int | None) -> Column:
    """The group a key's state is kept in: one of ``slots``, or its own."""
    return (F.col(key) if slots is None else F.pmod(F.xxhash64(key), F.lit(slots))).cast("string").alias("slot")


def _blocks(rows: Iterator[pd.DataFrame], at_least: int) -> Iterator[pd.DataFrame]:
    """Chunks put together until they have so many rows."""
    held: list[pd.DataFrame] = []
    for chunk in rows:
        held.append(chunk)
        if sum(map(len, held)) >= at_least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


class _Expiring(StatefulProcessor):
    """State of one key or slot that one timer ends."""

    handle: StatefulProcessorHandle

    def ends(self, at_us: int) -> None:
        """Clear the state once the watermark reaches this time."""
        at_ms = -(-at_us // 1000)
        timers = list(self.handle.listTimers())
        if timers != [at_ms]:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def clear(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Attempts(_Expiring):
    """Counts attempts of a slot's keys in one window, until the window is over."""

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "keys array<string>, counts array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        counts = dict(zip(*held)) if held else {}
        for block in _blocks(rows, HELD_ROWS):
            ordered = block.sort_values(["ts", "seq"])
            numbers = []
            for of in ordered["key"]:
                counts[of] = counts.get(of, 0) + 1
                numbers.append(counts[of])
            yield pd.DataFrame({
                "key": [str(of) for of in ordered["key"]], "bucket": int(key[1]), "seq": ordered["seq"].to_numpy(), "n": numbers,
                "allowed": [self.limit <= 0 or i <= self.limit for i in numbers],
            })
        self.count.update((list(counts), list(counts.values())))
        self.ends((int(key[1]) + 1) * self.window_us)

    def clear(self) -> None:
        self.count.clear()


def stream_rate_limit(
    attempts: DataFrame, limit: int, window_s: int = 60, late_after: str = LATE_AFTER, slots: int | None = None
) -> DataFrame:
    """Number and admit attempts (key, ts, seq) in arrival order per fixed window.

    State is kept per window and key, or per window and one of ``slots`` groups of keys, so the windows of
    a busy key spread over tasks, and goes once the watermark has passed the window: what came later would
    be late. A slot's value holds the keys that are active in one window.
    """
    window_us = window_s * 1_000_000
    keyed = _watermarked(attempts, late_after).select(
        F.col("key").cast("string").alias("key"), "ts", F.col("seq").cast("bigint").alias("seq"),
        F.floor(F.unix_micros("ts") / window_us).alias("bucket"),
    ).select("*", _slot("key", slots))
    return keyed.groupBy("slot", "bucket").transformWithStateInPandas(
        _Attempts(limit, window_us), "key string, bucket bigint, seq bigint, n bigint, allowed boolean", "Append", "EventTime"
    )


class _Newest(_Expiring):
    """Keeps the newest payload of one key until it expires."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl_us = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "at bigint, seq bigint, payload string, expires bigint")

    def _row(self, key: Any, held: tuple, expired: bool) -> pd.DataFrame:
        at, seq, payload, expires = held
        return pd.DataFrame({"key": [str(key[0])], "at": [at], "seq": [seq], "payload": [None if expired else payload],
                             "expires": [expires], "expired": [expired]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.state.get()) if self.state.exists() else None
        for chunk in rows:
            top = chunk.sort_values(["at", "seq"]).iloc[-1]
            if best is None or (top["at"], top["seq"]) > (best[0], best[1]):
                best = (int(top["at"]), int(top["seq"]), top["payload"], int(top["at"]) + self.ttl_us)
        self.state.update(best)
        self.ends(best[3])
        yield self._row(key, best, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get())
        self.state.clear()
        yield self._row(key, held, True)


def stream_latest(updates: DataFrame, ttl_s: int, late_after: str = LATE_AFTER) -> DataFrame:
    """Newest payload per key for updates (key, ts, seq, payload): (key, at, seq, payload, expires, expired).

    ``at`` and ``expires`` are epoch microseconds. A key emits its current value after each
    batch that touches it, and a row with ``expired`` and no payload when the watermark reaches
    ``expires``; its state is gone then. :func:`current` reads what is left.
    """
    keyed = _watermarked(updates, late_after).select(
        F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"),
        F.col("seq").cast("bigint").alias("seq"), F.col("payload").cast("string").alias("payload"),
    )
    return keyed.groupBy("key").transformWithStateInPandas(
        _Newest(ttl_s), "key string, at bigint, seq bigint, payload string, expires bigint, expired boolean", "Update", "EventTime"
    )


def current(written: DataFrame) -> DataFrame:
    """The keys that have a value now, from all rows that :func:`stream_latest` has written."""
    last = F.max_by(F.struct("at", "seq", "payload", "expires", "expired"), F.struct("at", "seq", "expired"))
    return written.groupBy("key").agg(last.alias("last")).select("key", "last.*").filter(~F.col("expired")).drop("expired")


def stream_latest_envelope(updates: DataFrame, ttl_s: int = ENVELOPE_TTL_S, late_after: str = LATE_AFTER) -> DataFrame:
    """Newest envelope per job for updates (job_id, ts, seq, envelope as JSON)."""
    return stream_latest(
        updates.select(F.col("job_id").alias("key"), "ts", "seq", F.col("envelope").alias("payload")), ttl_s, late_after
    )


def stream_tier_cache(attempts: DataFrame, ttl_s: int = TIER_TTL_S, late_after: str = LATE_AFTER) -> DataFrame:
    """Latest winning tier per domain; failed attempts leave it alone."""
    wins = attempts.filter(F.col("outcome") == "ok")
    return stream_latest(
        wins.select(F.col("domain").alias("key"), "ts", "seq", F.col("tier").alias("payload")), ttl_s, late_after
    )


class _TokenMaps(_Expiring):
    """The reversible maps of a slot: each stored once, handed out once, gone after its expiry."""

    def __init__(self, roles: list[str]) -> None:
        self.roles = roles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "map", "refs array<string>, owners array<string>, expires array<bigint>, used array<boolean>"
        )

    def _held(self) -> dict[str, tuple[str, int, bool]]:
        held = self.state.get()
        return {ref: (owner, expires, used) for ref, owner, expires, used in zip(*held)} if held else {}

    def _keep(self, held: dict[str, tuple[str, int, bool]]) -> None:
        """Store the maps, with a timer for the first of them to end."""
        self.state.update((list(held), *map(list, zip(*held.values()))))
        self.ends(min(expires for _, expires, _ in held.values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        answers = []
        # A request must not be answered before the map that came before it: a slot's part of a batch is put in order.
        ordered = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"])
        for ref, kind, at, seq, role, expires in zip(*[ordered[c].tolist() for c in ("ref", "kind", "at", "seq", "role", "expires")]):
            known = held.get(ref)
            if kind == "put":
                if known is None:
                    held[ref] = (role, int(expires), False)
                continue
            if role not in self.roles:
                status = "role_not_allowed"
            elif known is None or known[2] or at >= known[1]:
                status = "gone"
            else:
                status = "ok" if known[0] == role else "wrong_owner"
                held[ref] = (known[0], known[1], True)
            answers.append((str(ref), int(seq), status))
        if answers:
            yield pd.DataFrame(answers, columns=["ref", "seq", "status"])
        if held:
            self._keep(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ended, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        left = {ref: m for ref, m in self._held().items() if -(-m[1] // 1000) > ended and -(-m[1] // 1000) >= watermark}
        self.state.clear()
        if left:
            self._keep(left)
        return iter(())


def stream_token_maps(entries: DataFrame, late_after: str = LATE_AFTER, slots: int | None = None) -> DataFrame:
    """Answers (ref, seq, status) to requests for stored maps, each spent by its first request.

    ``entries`` holds (ref, kind: put or get, ts, seq, role, expires_at). A request by a role
    that may not revert leaves the map alone; one by another role than the owner spends it. Spent or
    not, a map's state goes when the watermark reaches its expiry. State is kept per ref, or per one of
    ``slots`` groups of refs; a group's value holds its live maps, so ``slots`` should grow with them.
    """
    keyed = _watermarked(entries, late_after).select(
        "ref", "kind", "ts", F.unix_micros("ts").alias("at"),
        F.col("seq").cast("bigint").alias("seq"), "role",
        F.coalesce(F.unix_micros(F.col("expires_at").cast("timestamp")), F.lit(0)).alias("expires"), _slot("ref", slots),
    )
    return keyed.groupBy("slot").transformWithStateInPandas(
        _TokenMaps(reversible_roles()), "ref string, seq bigint, status string", "Append", "EventTime"
    )
