"""A sliding request window per client: batch by an ordered fold, and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_batch(events: DataFrame, limit: int, window_seconds: int = 60) -> DataFrame:
    """(user_id, event_id, allowed): a request passes if fewer than ``limit`` accepted ones lie within the window; rejected ones do not count."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        kept: list[int] = []
        first, out = 0, []
        for t in pdf["ts"].astype("int64"):
            while first < len(kept) and t - kept[first] >= window_seconds * 1_000_000_000:
                first += 1
            ok = len(kept) - first < limit
            if ok:
                kept.append(t)
            out.append(ok)
        return pdf[["user_id", "event_id"]].assign(allowed=out)

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(fold, "user_id long, event_id long, allowed boolean")


def limit_stream(events: DataFrame, limit: int, window_seconds: int = 60) -> DataFrame:
    """The same over a stream; the state is the times of accepted requests within the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for t in pdf["ts"].astype("int64"):
            kept = [x for x in kept if t - x < window_seconds * 1_000_000_000]
            out.append(len(kept) < limit)
            if out[-1]:
                kept.append(int(t))
        state.update((kept,))
        yield pdf[["user_id", "event_id"]].assign(allowed=out)

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows, for a stream (with a watermark) or a batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
