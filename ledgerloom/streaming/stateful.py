"""Streams with state that ends: a cache with a time to live, request windows of clients that go idle, samples at fixed times.

All need the RocksDB state store (``STORE``). A key's rows of one batch are taken in order of time; state is kept for
each key apart and goes when its time is over, so it is bounded by the keys seen within that time.

Defined cases: rows without time or key are dropped; rows of equal time go by id; late rows, behind the
watermark, are dropped by Spark before they come here (event time only).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def millis(ts) -> int:
    """Milliseconds since 1970 of a time that Spark hands to Python in the session's zone."""
    return int(round(ts.timestamp() * 1000))


class _Cache(StatefulProcessor):
    """The last answer of a key, for ``ttl_ms`` after it was written."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "reply string, cost_usd double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ts, r.call_id)):
            hit = self.answer.exists()
            if not hit:
                self.answer.update((r.reply, r.cost_usd))
            reply, cost = self.answer.get()
            yield Row(key=key[0], call_id=r.call_id, reply=reply, cost_usd=cost, hit=hit)

    def close(self) -> None:
        pass


def cached_stream(calls: DataFrame, ttl_seconds: float = 3600) -> DataFrame:
    """(key, call_id, reply, cost_usd, hit) of a stream of (key, call_id, ts, reply, cost_usd) calls: a key's first reply answers all its calls until it expires.

    The time to live counts from the write, in processing time.
    """
    clean = calls.filter("key is not null and ts is not null").select("key", "call_id", "ts", "reply", F.col("cost_usd").cast("double").alias("cost_usd"))
    return clean.groupBy("key").transformWithState(_Cache(int(ttl_seconds * 1000)), "key string, call_id long, reply string, cost_usd double, hit boolean", "append", "ProcessingTime")


class _Limiter(StatefulProcessor):
    """The times of a client's accepted requests within the window; a timer removes them when the last has left it."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = list(self.kept.get()[0]) if self.kept.exists() else []
        old = kept[-1] + self.window_ms if kept else None
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            t = millis(r.ts)
            kept = [x for x in kept if t - x < self.window_ms]
            allowed = len(kept) < self.limit
            if allowed:
                kept.append(t)
            yield Row(user_id=key[0], event_id=r.event_id, allowed=allowed)
        self.kept.update((kept,))
        new = kept[-1] + self.window_ms
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, limit: int, window_seconds: float = 60, late: str = "0 seconds") -> DataFrame:
    """(user_id, event_id, allowed) of a stream of (user_id, event_id, ts): a request passes if fewer than ``limit`` accepted ones lie within the window.

    Rejected requests don't count. Once the watermark has passed a client's window, nothing is kept of that client.
    """
    clean = events.filter("user_id is not null and ts is not null").select("user_id", "event_id", "ts").withWatermark("ts", late)
    return clean.groupBy("user_id").transformWithState(_Limiter(limit, int(window_seconds * 1000)), "user_id long, event_id long, allowed boolean", "append", "EventTime")


class _Sampler(StatefulProcessor):
    """Counts and the last value of a source, told at every full ``every_ms`` until ``idle`` of them pass without a row."""

    def __init__(self, every_ms: int, idle: int):
        self.every_ms, self.idle = every_ms, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last double, peak double, quiet int, told long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last, peak, _, told = self.seen.get() if self.seen.exists() else (0, None, None, 0, None)
        first = None
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            first = millis(r.ts) if first is None else first
            n, last, peak = n + 1, r.value, r.value if peak is None else max(peak, r.value)
        if told is None:
            told = first // self.every_ms * self.every_ms
            self.handle.registerTimer(told + self.every_ms)
        self.seen.update((n, last, peak, 0, told))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        n, last, peak, quiet, _ = self.seen.get()
        yield Row(source=key[0], at_ms=at, n=n, last=last, peak=peak)
        if quiet + 1 >= self.idle:
            self.seen.clear()
        else:
            self.seen.update((n, last, peak, quiet + 1, at))
            self.handle.registerTimer(at + self.every_ms)

    def close(self) -> None:
        pass


def sampled_stream(events: DataFrame, every_seconds: float, idle: int = 3, late: str = "0 seconds") -> DataFrame:
    """(source, at_ms, n, last, peak) of a stream of (source, event_id, ts, value): what had come from a source when the watermark passed each full interval."""
    clean = events.filter("source is not null and ts is not null and value is not null").select("source", "event_id", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return clean.groupBy("source").transformWithState(_Sampler(int(every_seconds * 1000), idle), "source string, at_ms long, n long, last double, peak double", "append", "EventTime")
