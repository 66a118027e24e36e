from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import barriers, labels

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def candles(spark):
    rng, rows = np.random.default_rng(3), []
    for s, n in (("A", 260), ("B", 90), ("C", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.003, n)))
        for i in range(n):
            c = float(close[i])
            gone = rng.random()
            rows.append((s, "1h", T0 + timedelta(hours=i), None if gone < 0.03 else c * 1.002, None if gone > 0.97 else c * 0.998, None if 0.5 < gone < 0.52 else c, "x"))
    return spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, high double, low double, close double, n string").repartition(3)


@pytest.mark.parametrize("p, bits, width", [(1, 2, 0.004), (7, 2, 0.01), (50, 2, 0.02), (64, 3, 0.03), (200, 2, 0.05), (200, 6, 0.03)])
def test_far_barriers_equal_the_array_form(candles, p, bits, width):
    want = labels.triple_barrier(candles, p, width, width, "t")
    got = barriers.far_barrier(candles, p, width, width, "t", bits)
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, d.collect()), key=str) for d in (got, want))
    assert a == b and any(r[8] == "UP" for r in a) | any(r[8] == "DOWN" for r in a)


@pytest.mark.parametrize("side", ["up", "down", "both"])
def test_first_events_equal_hazards(candles, side):
    want = labels.hazard(candles, 40, 0.02, side).withColumn("event_step", labels.time_to_event(40)).select("symbol", "ts", "event_step")
    got = barriers.first_event(candles, 40, 0.02, side, bits=2).select("symbol", "ts", "event_step")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_horizon_over_many_rows(spark):
    """A horizon of 5,000 over 100,000 rows: no row carries more than a unit's 64 parts."""
    x = F.col("id")
    price = 100 + 10 * F.sin(x / 3000) + (F.pmod(F.xxhash64(x), F.lit(1000)) / 1000)
    df = spark.range(100_000).select(F.lit("A").alias("symbol"), F.lit("1m").alias("interval"), F.timestamp_seconds(x * 60).alias("ts"), price.alias("close"), (price + 0.1).alias("high"), (price - 0.1).alias("low"))
    got = {r.n: r.touch_t for r in barriers.far_barrier(df.withColumn("n", F.unix_timestamp("ts") / 60), 5000, 0.04, 0.04, "t").where("n % 997 = 0").select("n", "touch_t").collect()}
    pdf = df.orderBy("ts").toPandas()
    close, high, low = (pdf[c].to_numpy() for c in ("close", "high", "low"))
    for n, touch in got.items():
        n = int(n)
        if n + 5000 >= len(close):
            assert touch is None
            continue
        up, down = high[n + 1 : n + 5001] >= close[n] * 1.04, low[n + 1 : n + 5001] <= close[n] * 0.96
        at = np.flatnonzero(up | down)
        assert touch == ("NO_TOUCH" if not len(at) else "UP" if up[at[0]] else "DOWN")
