"""The sliding-log limiter over a stream, with list state for each window and a timer for idle keys.

Keys are dealt to buckets, and a bucket is the group that has state: a call of the processor,
its reads and writes of state and its timer cost milliseconds, so they are paid for some
thousand events at a time and not for each key.  A bucket has a list of let-through times
with their keys for each window.  A batch of its events is taken by time, then id; times whose
window and ``idle`` seconds the watermark has passed are left out of what is written back, and
one event-time timer is set, for when the last of them gets that old.  When the watermark
reaches it, the bucket's lists go.  So the state holds keys that were active lately and
nothing else.

Needs the RocksDB state store: ``with rocksdb(spark): ... .start()``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.streaming.limiter import Log, Window

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that list state and timers need, for streams that are started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


#: Buckets of a stream, and events of a batch's bucket that ``buckets_for`` aims at.
BUCKETS, BUCKET_EVENTS = 1024, 8192


def buckets_for(events: int) -> int:
    """Buckets for batches of so many events: as many as keep a bucket's share of a batch small; it has to stay as it is over a stream's life."""
    return max(64, -(-events // BUCKET_EVENTS))


class Limiter(StatefulProcessor):
    """Rows (bucket, id, key, ts) to rows with ``allowed`` and ``retry``; the group is the bucket."""

    def __init__(self, windows: tuple[Window, ...], idle: float) -> None:
        self.windows, self.idle = windows, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = [handle.getListState(f"window{k}", "key string, ts double") for k in range(len(self.windows))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable")
        logs: dict[str | None, Log] = {}
        for n, state in enumerate(self.lists):
            for k, t in state.get():
                if k not in logs:
                    logs[k] = Log(self.windows)
                logs[k].kept[n].append(float(t))
        out = []
        for k, t in zip(pdf.key, pdf.ts):
            if k not in logs:
                logs[k] = Log(self.windows)
            out.append(logs[k].hit(t))
        passed, end = timerValues.getCurrentWatermarkInMs() / 1000, 0.0
        for n, (w, state) in enumerate(zip(self.windows, self.lists)):
            keep = w.period + self.idle
            kept = [(k, float(t)) for k, log in logs.items() for t in log.kept[n] if t + keep > passed]
            state.put(kept) if kept else state.clear()
            end = max([end, *(t + keep for _, t in kept)])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, (tuple, list)) else at)
        if end:
            self.handle.registerTimer(int(end * 1000))
        yield pdf.assign(allowed=[o[0] for o in out], retry=[float(o[1]) for o in out])[["id", "key", "ts", "allowed", "retry"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.lists:
            state.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "key": pd.Series(dtype="str"), "ts": pd.Series(dtype="float64"), "allowed": pd.Series(dtype="bool"), "retry": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def limit_timed(events: DataFrame, windows: tuple[Window, ...], key_col: str, ts_col: str, id_col: str, late: str = "10 minutes", idle: float = 60.0, buckets: int = BUCKETS) -> DataFrame:
    """``id, key, ts, allowed, retry`` of a stream's events, in event time; events more than ``late`` behind the newest are left out.

    ``buckets`` are the groups that keys are dealt to; a checkpoint is bound to their number.
    """
    ts = F.col(ts_col).cast("timestamp")
    key = F.col(key_col).cast("string")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    rows = events.select(bucket, F.col(id_col).cast("long").alias("id"), key.alias("key"), (F.unix_micros(ts) / 1_000_000).alias("ts"), ts.alias("at")).withWatermark("at", late)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Limiter(windows, idle), outputStructType="id long, key string, ts double, allowed boolean, retry double", outputMode="Append", timeMode="EventTime")
