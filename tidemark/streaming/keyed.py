"""State kept for each key of a stream: typed, in the state store, with event-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, us long, out double"


class InTimeOrder(StatefulProcessor):
    """Rows of a key wait until the watermark passes them and are then taken in order of time; one that comes when a later one has been
    taken is dropped.

    What waits lies in buckets of ``width`` microseconds of event time, each as the chunks in which it came (arrays of times and of values
    under bucket and chunk number), beside a small row a bucket. So a batch writes what it brings, and a timer reads the buckets that the
    watermark has reached: each row is written once and read once, or once more for each batch in which the watermark stops inside its
    bucket. The key's own state (time of the last row taken, and what ``step`` remembers) is a row of its own.
    """

    def __init__(self, step: Callable[[float | None, float], tuple[float, float]], width: int):
        self.step, self.width = step, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "bucket long, n long", "us array<long>, v array<double>")
        self.buckets = handle.getMapState("buckets", "bucket long", "chunks long, least long")
        self.now = handle.getValueState("now", "last long, memory double")

    def hold(self, bucket: int, us: np.ndarray, v: np.ndarray) -> None:
        chunks, least = self.buckets.getValue((bucket,)) or (0, int(us.min()))
        self.chunks.updateValue((bucket, chunks), (us.tolist(), v.tolist()))
        self.buckets.updateValue((bucket,), (chunks + 1, min(least, int(us.min()))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))
        last = self.now.get()[0] if self.now.exists() else None
        us, v = x["us"].to_numpy(np.int64), x["v"].to_numpy(float)
        if last is not None:
            us, v = us[us >= last], v[us >= last]
        if len(us):
            order = np.argsort(us, kind="stable")
            us, v = us[order], v[order]
            edges = np.flatnonzero(np.diff(us // self.width, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(us)], strict=True):
                self.hold(int(us[a] // self.width), us[a:b], v[a:b])
            self.handle.registerTimer(max(int(us[0]) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def taken(self, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows before ``mark``, in order; the rest of a bucket that it cuts is held again as one chunk."""
        times, values = [], []
        for bucket in sorted(b[0] for b, (_, least) in list(self.buckets.iterator()) if least < mark):
            n = self.buckets.getValue((bucket,))[0]
            parts = [self.chunks.getValue((bucket, i)) for i in range(n)]
            us, v = (np.concatenate([np.asarray(p[i], t) for p in parts]) for i, t in ((0, np.int64), (1, float)))
            for i in range(n):
                self.chunks.removeKey((bucket, i))
            self.buckets.removeKey((bucket,))
            if (late := us >= mark).any():
                self.hold(bucket, us[late], v[late])
                us, v = us[~late], v[~late]
            order = np.lexsort((v, us))
            times.append(us[order])
            values.append(v[order])
        return (np.concatenate(times), np.concatenate(values)) if times else (np.zeros(0, np.int64), np.zeros(0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        us, v = self.taken(mark * 1000)
        memory, out = (self.now.get()[1] if self.now.exists() else None), []
        for x in v.tolist():
            memory, y = self.step(memory, x)
            out.append(y)
        if len(us):
            self.now.update((int(us[-1]), memory))
        waiting = [least for _, (_, least) in self.buckets.iterator()]
        if waiting:
            self.handle.registerTimer(max(min(waiting) // 1000 + 1, mark + 1))
        if len(us):
            yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(us), dtype=object), "us": us, "out": np.array(out, float)})

    def close(self) -> None:
        pass


def in_time_order(df: DataFrame, step: Callable[[float | None, float], tuple[float, float]], value: str, late: str, key: str = "symbol", width: str = "1 minute") -> DataFrame:
    """``symbol, ts, out``: ``step`` maps what a key remembers (null at first) and a value to what it remembers then and the output, over the
    key's rows in order of ``ts`` (of one time by value). Rows wait for the watermark, ``late`` behind the latest event.

    The stream must start with RocksDB as the state store (``run.rocksdb``); with its checkpoint it goes on where it stopped.
    """
    us = int(pd.Timedelta(width) / pd.Timedelta("1us"))
    t = df.withWatermark("ts", late).select(F.col(key).alias("symbol"), "ts", F.unix_micros("ts").alias("us"), F.col(value).cast("double").alias("v"))
    out = t.where("v is not null").groupBy("symbol").transformWithStateInPandas(InTimeOrder(step, us), OUT, "Append", "EventTime")
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "out")


def ema_step(span: int) -> Callable:
    a = 2.0 / (span + 1)

    def step(y, x):
        y = x if y is None else (1 - a) * y + a * x
        return y, y

    return step


def hysteresis_step(high: float, width: float) -> Callable:
    def step(on, p):
        on = 1.0 if p >= high else 0.0 if p <= max(0.0, high - width) else (on or 0.0)
        return on, on

    return step
