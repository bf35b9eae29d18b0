"""A sliding-log rate limiter: over a batch by key, and over a stream with state.

An event is let through if fewer than ``limit`` earlier let-through events of its key
lie within the last ``period`` seconds; denied events aren't recorded.  With several
windows each is charged by itself, and the longest wait counts; a wait of exactly zero
passes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    limit: int
    period: float
    name: str = ""


# Requests allowed by endpoint, in a burst and over a longer time.
LIMITS = {
    "search": (Window(30, 60.0, "search_burst"), Window(300, 3600.0, "search_hourly")),
    "answers": (Window(10, 60.0, "answers_burst"), Window(80, 3600.0, "answers_hourly")),
    "login": (Window(10, 60.0, "login_burst"), Window(60, 3600.0, "login_hourly")),
    "register": (Window(5, 60.0, "register_burst"), Window(20, 3600.0, "register_hourly")),
}


class Log:
    """The let-through times of one key, for each window."""

    def __init__(self, windows: tuple[Window, ...], kept: list[list[float]] | None = None) -> None:
        self.windows = windows
        self.kept = [deque(k) for k in kept] if kept else [deque() for _ in windows]

    def hit(self, now: float) -> tuple[bool, float]:
        wait = 0.0
        for w, q in zip(self.windows, self.kept):
            while q and q[0] <= now - w.period:
                q.popleft()
            if len(q) >= w.limit:
                wait = max(wait, q[0] + w.period - now)
            else:
                q.append(now)
        return wait <= 0, wait


def limiter_key(endpoint: Column, user: Column, ip: Column) -> Column:
    """The user if there is one, else the address; always the address for account pages."""
    return F.when(endpoint.isin("login", "register") | user.isNull(), F.concat(F.lit("ip:"), ip)).otherwise(F.concat(F.lit("user:"), user.cast("string")))


def limit_batch(events: DataFrame, windows: tuple[Window, ...], key_col: str, ts_col: str, id_col: str) -> DataFrame:
    """``id, key, ts, allowed, retry`` for each event; a key's events are taken by time, then id.

    A key's events are folded in order, in Arrow batches sorted by key and time, so a hot
    key streams through one task without being held.
    """
    seconds = (F.unix_micros(F.col(ts_col).cast("timestamp")) / 1_000_000).alias("ts")
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.col(key_col).cast("string").alias("key"), seconds)
    dealt = rows.repartition("key").sortWithinPartitions("key", "ts", "id")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log, first = None, None, True
        for pdf in pdfs:
            out = []
            for k, ts in zip(pdf.key, pdf.ts):
                if first or k != key:
                    key, log, first = k, Log(windows), False
                out.append(log.hit(ts))
            yield pdf.assign(allowed=[o[0] for o in out], retry=[float(o[1]) for o in out])

    return dealt.mapInPandas(run, "id long, key string, ts double, allowed boolean, retry double")


def limit_stream(events: DataFrame, windows: tuple[Window, ...], key_col: str, ts_col: str, id_col: str, late: str = "10 minutes", idle: float = 60.0) -> DataFrame:
    """The same over a stream, in event time; events more than ``late`` behind the newest are left out.

    The state of a key is its let-through times within the longest window; it goes when
    the watermark has passed the last event by that window and ``idle`` seconds.
    """
    ts = F.col(ts_col).cast("timestamp")
    rows = events.select(F.col(id_col).cast("long").alias("id"), F.col(key_col).cast("string").alias("key"), (F.unix_micros(ts) / 1_000_000).alias("ts"), ts.alias("at")).withWatermark("at", late)
    longest = max(w.period for w in windows) + idle

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = Log(windows, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "id"])
        out = [log.hit(t) for t in rows.ts]
        state.update(([list(map(float, q)) for q in log.kept],))
        state.setTimeoutTimestamp(max(int((rows.ts.max() + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=[o[0] for o in out], retry=[float(o[1]) for o in out])[["id", "key", "ts", "allowed", "retry"]]

    return rows.groupBy("key").applyInPandasWithState(step, "id long, key string, ts double, allowed boolean, retry double", "kept array<array<double>>", "append", "EventTimeTimeout")
