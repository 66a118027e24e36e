from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versions import Version, VersionedTable, filled_over
from tidemark.streaming import jobs, run

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "day string, k long, v double"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, F.col("day"))


def put(spark, table, rows, **options):
    return table.change(spark.createDataFrame(rows, SCHEMA), lambda old, new: filled_over(old, new, ["day", "k"]), **options)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_touch_only_their_partitions(spark, table):
    assert table.read().count() == 0 and table.version().number == 0
    first = put(spark, table, [("a", 1, 1.0), ("b", 2, 2.0), (None, 3, 3.0), ("x/y: z", 4, 4.0)])
    second = put(spark, table, [("a", 1, None), ("a", 5, 5.0)])
    assert second.number == 2 and second.parts["b"] == first.parts["b"] and second.parts["a"] != first.parts["a"]
    assert told(table.read()) == told(spark.createDataFrame([("a", 1, 1.0), ("a", 5, 5.0), ("b", 2, 2.0), (None, 3, 3.0), ("x/y: z", 4, 4.0)], SCHEMA))
    assert told(table.read(1)) == told(spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), (None, 3, 3.0), ("x/y: z", 4, 4.0)], SCHEMA))


def test_a_reader_sees_one_version_while_another_is_written(spark, table):
    put(spark, table, [("a", 1, 1.0), ("b", 2, 2.0)])
    reading = table.read()
    put(spark, table, [("a", 1, 9.0), ("b", 2, 9.0)])
    assert told(reading) == [("a", 1, 1.0), ("b", 2, 2.0)] and told(table.read()) == [("a", 1, 9.0), ("b", 2, 9.0)]


def test_a_batch_is_in_once_and_a_dead_write_leaves_nothing(spark, table):
    put(spark, table, [("a", 1, 1.0)], writer="s", batch=0)
    put(spark, table, [("a", 1, 5.0)], writer="s", batch=0)
    assert told(table.read()) == [("a", 1, 1.0)]

    def dies(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.change(spark.createDataFrame([("a", 1, 7.0)], SCHEMA), dies, "s", 1)
    table._written(spark.createDataFrame([("a", 1, 7.0)], SCHEMA))  # files without a version
    assert told(table.read()) == [("a", 1, 1.0)] and table.version().number == 1
    put(spark, table, [("a", 1, 7.0)], writer="s", batch=1)
    assert told(table.read()) == [("a", 1, 7.0)]


def test_of_two_writers_the_later_starts_anew(spark, table):
    put(spark, table, [("a", 1, 1.0)])
    assert not table.publish(Version(1, {}, {}))
    tried = []

    def slow(old, new):
        if not tried:
            tried.append(1)
            put(spark, table, [("a", 2, 2.0)])  # another one comes first
        return filled_over(old, new, ["day", "k"])

    out = table.change(spark.createDataFrame([("a", 3, 3.0)], SCHEMA), slow)
    assert out.number == 3 and told(table.read()) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)]


def test_expired_versions_go(spark, table):
    for i in range(4):
        put(spark, table, [("a", i, 1.0)] + ([("b", 0, 0.0)] if not i else []))
    assert table.expire(keep=2) == 2 and table.numbers() == [3, 4]
    assert told(table.read(3)) == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 0, 0.0)] and table.read().count() == 5


def test_snapshot_stream_over_batches(spark, tmp_path):
    """Two batches, one of them run again: cells that a message lacks stay, malformed messages go."""
    rows = [
        [(T0 + timedelta(minutes=1), '{"count": 5, "vsize": 7, "fee_histogram": [[1, 1], [3, 3]]}'), (T0 + timedelta(minutes=3), '{"count": 6}'), (T0, "{broken")],
        [(T0 + timedelta(minutes=9), '{"vsize": 8}'), (T0 + timedelta(days=1), '{"fastestFee": 2, "economyFee": 1}')],
    ]
    schema, folder = "event_time timestamp, payload string", str(tmp_path / "in")
    columns = [c for c in jobs.snapshots_of(spark.createDataFrame([], schema)).columns if c != "event_time"]
    grid = spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if c == 'ts' else 'double'}" for c in [*columns, "onch_height"]))
    table = VersionedTable(spark, str(tmp_path / "t"), grid.schema, F.date_format("ts", "yyyy-MM-dd"))
    assert len(columns) == 11
    upsert = jobs.snapshot_upserts(table)
    for number, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        run.drained_batches(spark.readStream.schema(schema).parquet(folder), upsert, str(tmp_path / "place"))
        upsert(spark.createDataFrame([(T0, '{"count": 999}')], schema), number)  # a batch of that number is in
    got = {(r.ts - T0.replace(tzinfo=None)).days: r for r in table.read().collect()}
    assert table.version().batches == {"snapshots": 1}
    assert (got[0].onch_mempool_count, got[0].onch_mempool_vsize_vB, got[0].onch_fee_wavg_satvb, got[0].onch_fee_p50_satvb) == (6.0, 8.0, 2.5, 3.0)
    assert (got[1].onch_fee_fast_satvb, got[1].onch_fee_min_satvb, got[1].onch_mempool_count) == (2.0, 1.0, None) and len(got) == 2


def test_a_batch_that_dies_before_or_after_publication_lands_once(spark, tmp_path):
    schema, folder, place = "k long, ts timestamp, v double, n long", str(tmp_path / "in"), str(tmp_path / "place")
    rows = lambda *xs: spark.createDataFrame([(k, T0 + timedelta(minutes=m), v, n) for k, m, v, n in xs], schema).coalesce(1).write.mode("append").parquet(folder)
    table = VersionedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, ts timestamp, v double").schema, F.col("k") % 2)
    land, deaths = jobs.landing_once(table, ["k"], "n"), ["before", "after"]

    def dying(df, number):
        now = deaths[0] if deaths and df.where("k = 3").count() else None
        if now == "before":
            deaths.pop(0)
            raise RuntimeError("before")
        land(df, number)
        if now == "after":
            deaths.pop(0)
            raise RuntimeError("after")

    def play():
        stream = jobs.deduplicated(spark.readStream.schema(schema).parquet(folder), ["k"], "1 hour")
        with run.rocksdb(spark):
            run.drained_batches(stream, dying, place)

    rows((1, 0, 1.0, 1), (2, 1, 2.0, 2), (1, 2, 9.0, 3))
    play()
    rows((2, 3, 9.0, 4), (3, 4, 3.0, 5), (3, 4, 3.0, 5), (4, 600, 4.0, 6))
    for _ in range(2):
        with pytest.raises(Exception, match="before|after"):
            play()
    play()
    rows((1, 900, 9.0, 9), (5, 901, 5.0, 10))  # the stream has forgotten 1, the table has not
    play()
    got = sorted((r.k, r.v) for r in table.read().collect())
    assert not deaths and [k for k, _ in got] == [1, 2, 3, 4, 5] and got[2:] == [(3, 3.0), (4, 4.0), (5, 5.0)]
