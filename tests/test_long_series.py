import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, parts, windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def candles(spark):
    rng, n = np.random.default_rng(7), 1500
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    pdf = pd.DataFrame({
        "symbol": ["A"] * 1300 + ["B"] * 200, "interval": "15m", "ts": [(T0 + timedelta(minutes=15 * i)).isoformat() for i in range(n)], "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
        "volume": rng.uniform(1, 5, n), "quote_asset_volume": rng.uniform(100, 500, n), "taker_buy_base": rng.uniform(0, 1, n), "taker_buy_quote": rng.uniform(0, 100, n),
        "number_of_trades": rng.integers(1, 9, n), "open_interest": np.where(rng.random(n) < 0.3, rng.uniform(1, 9, n), None), "funding_rate": rng.normal(size=n), "ethbtc_close": close[::-1].copy(),
    })
    pdf.loc[200:700, "open_interest"] = None
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "symbol string, interval string, ts string, open double, high double, low double, close double, volume double, quote_asset_volume double, taker_buy_base double, taker_buy_quote double, number_of_trades long, open_interest double, funding_rate double, ethbtc_close double").withColumn("ts", F.col("ts").cast("timestamp")).repartition(5)


def test_features_by_blocks_equal_those_of_the_whole_series(candles):
    settings = features.Settings(step_minutes=15, onchain=False, orderbook=False)
    whole = features.create_features(candles, settings)
    blocks = features.create_features(candles, settings, block_rows=300)
    assert whole.columns == blocks.columns
    a, b = (d.orderBy("symbol", "ts").toPandas() for d in (whole, blocks))
    assert len(a) == len(b) == 1500
    for c in whole.columns[3:]:
        assert np.allclose(a[c], b[c], rtol=1e-4, atol=1e-6), c


def test_no_window_has_a_whole_series(candles):
    blocks = features.create_features(candles, features.Settings(step_minutes=15, onchain=False, orderbook=False), block_rows=300)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert keys and all("symbol" in k for k in keys)
    assert "concat_ws" in plan  # the symbol of these windows is that of a block


def test_averages_of_long_series(candles):
    x = candles.withColumn("x", F.when(F.col("number_of_trades") > 2, F.col("close")))
    wanted = {"y2": ("x", 2), "y96": ("x", 96)}
    a, b = (windows.emas(x, wanted, block=16, long=long).orderBy("symbol", "ts").select("y2", "y96").toPandas() for long in (False, True))
    assert np.allclose(a, b, equal_nan=True)


def test_running_aggregates_over_parts(spark):
    rows = [("A", i, i % 7 if i % 3 else None) for i in range(500)] + [("B", i, 1) for i in range(5)]
    df = parts.in_parts(spark.createDataFrame(rows, "k string, i long, v long").repartition(4), ["k"], ["i"], 9)
    assert df.where("k = 'A'").select("_part").distinct().count() > 5
    v = F.col("v")
    for back in (False, True):
        got = {(r.k, r.i): r for r in parts.running(df, ["k"], ["i"], backwards=back, s=("sum", v), lo=("min", v), hi=("max", v), last=("last", v), x=("xor", v)).collect()}
        got_before = {(r.k, r.i): r.n for r in parts.running(df, ["k"], ["i"], backwards=back, before=True, n=("sum", F.lit(1))).collect()}
        for k in "AB":
            series = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if back else r[1])
            have, x, last = [], 0, None
            for n, (_, i, value) in enumerate(series):
                if value is not None:
                    have.append(value)
                    x, last = x ^ value, value
                r = got[k, i]
                want = (sum(have), min(have), max(have), last, x) if have else (None,) * 5
                assert (r.s, r.lo, r.hi, r["last"], r.x) == want and got_before[k, i] == (n or None)
