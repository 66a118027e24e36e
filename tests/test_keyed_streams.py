import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import keyed, run

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "symbol string, ts timestamp, v double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def play(spark, folder, place, step, late="1 hour", **options):
    """Takes what is in ``folder`` since the last time, a file a batch; returns all rows so far."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = keyed.in_time_order(stream, step, "v", late, **options).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint")
    with run.rocksdb(spark):
        q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("symbol string, ts timestamp, out double").parquet(f"{place}/out")


def plain(rows, step):
    memory, out = {}, []
    for s, ts, v in sorted(rows):
        memory[s], y = step(memory.get(s), v)
        out.append((s, ts.timestamp(), y))
    return out


def told(df):
    return sorted((r.symbol, r.t, r.out) for r in df.select("symbol", "out", F.unix_micros("ts").alias("t")).toLocalIterator())


def test_shuffled_rows_come_out_in_order_and_restarts_go_on(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, T0 + timedelta(seconds=int(i) * 97), float(rng.integers(0, 30))) for s in "AB" for i in range(300)]
    chunks = [sorted(rows, key=lambda r: r[1])[i : i + 100] for i in range(0, 600, 100)]
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")
    for c in chunks[:3]:
        write(spark, folder, [c[i] for i in rng.permutation(len(c))])
    first = told(play(spark, folder, place, keyed.ema_step(5)))
    assert first
    for c in chunks[3:]:
        write(spark, folder, [c[i] for i in rng.permutation(len(c))])
    write(spark, folder, [("A", T0 + timedelta(seconds=5), 1e9)])  # long past the watermark
    got = told(play(spark, folder, place, keyed.ema_step(5)))
    mark = max(r[1] for r in rows) - timedelta(hours=1)
    want = plain([r for r in rows if r[1] < mark], keyed.ema_step(5))
    assert len(got) == len(want) > len(first)
    assert all(a[0] == b[0] and a[1] == round(b[1] * 1e6) and abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, sorted(want), strict=True))


def test_equal_times_and_null_values(spark, tmp_path):
    at = [T0 + timedelta(minutes=i) for i in (0, 1, 1, 1, 200)]
    write(spark, str(tmp_path / "in"), list(zip("AAAAA", at, [1.0, 30.0, None, 3.0, 0.0], strict=True)))
    got = told(play(spark, str(tmp_path / "in"), str(tmp_path / "p"), keyed.hysteresis_step(20.0, 15.0)))
    assert [g[2] for g in got] == [0.0, 0.0, 1.0]  # of one time the smaller value first


def test_a_key_with_many_rows_waiting(spark, tmp_path):
    """Twice the rows in twice the batches take about twice the time, not four times: no batch reads what waits."""

    def seconds(n):
        folder, per = str(tmp_path / f"in{n}"), 20_000
        for k in range(n // per):
            pdf = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp(T0) + pd.to_timedelta(np.arange(per) * (n // per) + k, unit="ms"), "v": 1.0})
            spark.createDataFrame(pdf, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        write(spark, folder, [("B", T0 + timedelta(days=2), 0.0)])
        began = time.time()
        out = play(spark, folder, str(tmp_path / f"p{n}"), keyed.ema_step(5), late="1 hour")
        took = time.time() - began
        assert out.where("symbol = 'A'").count() == n and out.where("symbol = 'A' and out <> 1.0").count() == 0
        return took

    seconds(20_000)
    half, whole = seconds(100_000), seconds(200_000)
    assert whole < 3 * half + 5
