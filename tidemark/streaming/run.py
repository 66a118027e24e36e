"""Runs streams over what is there now."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, be it a file or a folder of files, as a stream with the schema that it has (the pattern makes a source of either)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as keyed state with timers needs it; other streams of the session are untouched."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def drained(stream: DataFrame) -> DataFrame:
    """All that an append query gives for the input that is there, from a Parquet sink with its checkpoint."""
    spark, place = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").outputMode("append")
    with rocksdb(spark):
        started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def drained_batches(stream: DataFrame, batch, place: str) -> None:
    """Feeds ``batch(df, id)`` with all that is there; ``place`` keeps the checkpoint for the next start."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
