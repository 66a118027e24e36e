"""Bars, snapshots, landing, rolling features and scoring on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timegrid import actuals
from ..sources.payloads import snapshot
from ..sources.shared import written
from ..sources.tables import insert_or_ignore
from ..sources.versions import VersionedTable, filled_over


def bars_stream(ticks: DataFrame, width: str, late: str, symbol: Column, price: Column, size: Column, tie: str = "event_id") -> DataFrame:
    """Tumbling candles; a tick that comes after the watermark has passed its bar is dropped, open bars are not emitted."""
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    t = t.select("ts", symbol.alias("symbol"), price.alias("px"), size.cast("double").alias("qty"), F.struct("ts", tie).alias("at"))
    out = t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("number_of_trades")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "number_of_trades")


def snapshots_of(messages: DataFrame, seconds: int = 900) -> DataFrame:
    """``event_time, ts`` and the ten columns of a snapshot from messages (``event_time``, ``payload``); malformed ones are passed over."""
    t = messages.where(F.try_parse_json("payload").isNotNull()).select("event_time", F.col("event_time").alias("fetched_at"), "payload")
    return snapshot(t, seconds, ["event_time"])


def latest(columns: Sequence[str], at: str = "event_time") -> list[Column]:
    """The last non-null value of each column, each by itself: a message that lacks a column does not undo it."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns]


def snapshot_stream(messages: DataFrame, seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """The merged messages of each grid bucket, when the watermark has passed it."""
    t = snapshots_of(messages.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late), seconds)
    columns = [c for c in t.columns if c not in ("event_time", "ts")]
    return t.groupBy(F.window("event_time", f"{seconds} seconds").alias("w")).agg(*latest(columns)).select(F.col("w.start").alias("ts"), *columns)


def snapshot_upserts(table: VersionedTable, seconds: int = 900, writer: str = "snapshots") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch of messages into the stored grid (``ts``, the ten columns and any others), whose cells stay where no
    message has a value. Of one batch the latest message holds; a later batch comes over an earlier one. Only the partitions of the batch
    are written anew, and the batch is in the table once, however often it runs."""

    def batch(df: DataFrame, number: int) -> None:
        t = snapshots_of(df.withColumn("event_time", F.col("event_time").cast("timestamp")), seconds)
        columns = [c for c in t.columns if c not in ("event_time", "ts")]
        new = written(t.groupBy("ts").agg(*latest(columns)), "snapshots")
        table.change(new, lambda old, rows: filled_over(old, rows, ["ts"]), writer, number)

    return batch


def landing(read_target: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], arrival: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends the rows of a batch whose key is new. With the checkpoint it restarts where it stopped; a batch
    that runs again finds its own rows and adds none."""

    def batch(df: DataFrame, _: int) -> None:
        write(insert_or_ignore(read_target(), df, keys, arrival))

    return batch


def deduplicated(rows: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    """The first row of each key; one that repeats it within ``late`` is dropped in the stream, whose state forgets keys behind the watermark. What
    comes later than that is the landing's to ignore."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def landing_once(table: VersionedTable, keys: list[str], arrival: str, writer: str = "landing") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: :func:`landing` into a versioned table. Rows and the batch's number are published together, so a batch that died between
    its write and the stream's commit is known when it comes again, and one that died before has left nothing."""

    def batch(df: DataFrame, number: int) -> None:
        rows = written(df, "arrived")
        table.change(rows, lambda old, new: old.unionByName(insert_or_ignore(old, new, keys, arrival)), writer, number)

    return batch


def scoring(score: Callable[[DataFrame], DataFrame], prices: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: scores a batch and fills the actuals that are known already."""

    def batch(df: DataFrame, _: int) -> None:
        write(actuals(score(df), prices()))

    return batch
