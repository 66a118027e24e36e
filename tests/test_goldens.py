"""Exact small goldens and invariants of the series operators."""

import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, scalars
from tidemark.operators import drift, evaluate, features, labels, models, splits, timegrid, windows
from tidemark.sources import payloads, scans, tables, versions
from tidemark.streaming import jobs, keyed, run

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)


def candles(spark, closes, minutes=15, highs=None, lows=None, symbol="A"):
    rows = []
    for i, c in enumerate(closes):
        h, low = (highs[i] if highs else c), (lows[i] if lows else c)
        rows.append((symbol, "15m", T0 + timedelta(minutes=minutes * i), c, h, low, c, 10.0 + i % 3, 1000.0, 4.0, 400.0))
    return spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double, quote_asset_volume double, taker_buy_base double, taker_buy_quote double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


def test_labels_sign_and_costs(spark):
    df = candles(spark, [100.0, 101.0, 102.0, 101.0, 99.0, 98.0])
    out = df.withColumns({"a": labels.sign_label(2), "b": labels.beyond_costs(2, 10), "c": labels.sign_label(2, null_tail=True)})
    assert column(out, "a") == [1, 0, 0, 0, 0, 0] and column(out, "b") == [1, 0, 0, 0, 0, 0] and column(out, "c")[-2:] == [None, None]


def test_triple_barrier(spark):
    close = [100.0] * 12
    high, low = [100.1] * 12, [99.9] * 12
    high[1], low[9] = 100.6, 99.0
    out = labels.triple_barrier(candles(spark, close, highs=high, lows=low), 8, 0.005, 0.005, "t")
    assert column(out, "touch_t") == ["UP", "DOWN", "DOWN", "DOWN"] + [None] * 8
    high[9] = 101.0  # both barriers on one bar: up wins
    out = labels.triple_barrier(candles(spark, close, highs=high, lows=low), 8, 0.005, 0.005, "t")
    assert column(out, "touch_t")[1:4] == ["UP"] * 3
    s = labels.touch_summary(out, ["t"]).first()
    assert (s.p_touch, s.p_up_given_touch) == (1.0, 1.0)


def test_hazard(spark):
    out = labels.hazard(candles(spark, [100.0, 100.0, 101.0, 101.0, 99.0]), 3, 0.005)
    assert column(out.withColumn("t", labels.time_to_event(3)), "t") == [2, 1, 2, 1, None]


def test_ema_matches_recursion_with_nulls(spark):
    pd = pytest.importorskip("pandas")
    x = [None if i % 7 in (2, 3) or i < 2 else 100 + (i * 37 % 11) / 3 for i in range(700)]
    df = spark.createDataFrame([("A", "1h", T0 + timedelta(hours=i), v) for i, v in enumerate(x)], "symbol string, interval string, ts timestamp, x double").repartition(5)
    for span in (2, 12, 96):
        got, want = column(windows.ema(df, "x", span, "y"), "y"), pd.Series(x, dtype=float).ewm(span=span, adjust=False).mean()
        assert all((g is None) == (w != w) and (g is None or abs(g - w) < 1e-9) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("gap", [700, 1000, 5000])
def test_ema_after_long_gaps(spark, gap):
    pd = pytest.importorskip("pandas")
    x = [40.0, 45.0, *[None] * gap, 50.0, 51.0, *[None] * 300, 7.0, *[60.0 + i % 5 for i in range(600)]]
    df = spark.createDataFrame([("A", "1h", T0 + timedelta(hours=i), v) for i, v in enumerate(x)], "symbol string, interval string, ts timestamp, x double").repartition(5)
    out = windows.emas(df, {"y2": ("x", 2), "y12": ("x", 12), "y96": ("x", 96)}, block=16).orderBy("ts").toPandas()
    for span in (2, 12, 96):
        want = pd.Series(x, dtype=float).ewm(span=span, adjust=False).mean()
        assert abs(out[f"y{span}"] - want).max() < 1e-9 and out[f"y{span}"].notna().all()


def test_volatility_regime_is_linear(spark):
    pd, n = pytest.importorskip("pandas"), 100_000
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.lit("1m").alias("interval"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (100 + F.sin("id") + (F.col("id") * 7 % 13) / 9).alias("close"))
    began = time.time()
    out = windows.volatility_regime(df).orderBy("ts").toPandas()
    assert time.time() - began < 60
    v = pd.Series(df.toPandas().close).pct_change().fillna(0).rolling(24, min_periods=12).std().bfill()
    assert abs(out.volatility - v).max() < 1e-9 and set(out.regime) == {"calm", "neutral", "volatile"}


def test_no_look_ahead_and_series_are_independent(spark):
    a = candles(spark, [100 + (i * 13 % 7) / 2 for i in range(120)])
    both = a.unionByName(a.withColumn("symbol", F.lit("B")).withColumn("close", F.col("close") * 2)).repartition(7)
    s = features.Settings(step_minutes=15, onchain=False, derivatives=False, orderbook=False, z_and_delta=False)
    whole = {(r.symbol, r.ts): r for r in features.create_features(both, s).collect()}
    cut = features.create_features(a.where(F.col("ts") < T0 + timedelta(minutes=15 * 80)), s).collect()
    assert len(cut) == 80 and all(whole[r.symbol, r.ts] == r for r in cut)
    assert all(t in ("string", "timestamp", "float") for _, t in features.create_features(a, s).dtypes)


def test_registered_features_are_there_whatever_the_inputs(spark):
    df = candles(spark, [100 + (i * 13 % 7) / 2 for i in range(80)])
    for s in (features.Settings(step_minutes=15, fill=-1.0), features.Settings(step_minutes=1440, fill=-1.0, z_and_delta=False), features.Settings(step_minutes=60, onchain=False, orderbook=False, derivatives=False, z_and_delta=False)):
        out = features.create_features(df, s)
        assert set(features.registered(s)) <= set(out.columns) and {"vol_volatility_60m", "time_tod_sin", "time_is_day"} <= set(out.columns)
        features.assert_finished(out)
        absent = ["cross_gold_corr_4h", *["lob_spread_bps", "wall_ask_size_rel", "deriv_liq_to_oi", "deriv_oi_velocity", "onch_height"] * s.onchain, *["mom_log_ret_15m", "vol_of_vol_1h"] * (s.step_minutes == 1440)]
        assert out.select(*absent).distinct().collect() == [tuple([s.fill] * len(absent))]
        assert not s.z_and_delta or out.select("d_deriv_oi_velocity").orderBy("d_deriv_oi_velocity").first()[0] == -1.0
    with pytest.raises(TypeError, match="note"):
        features.create_features(df.withColumn("note", F.lit("x")))
    with pytest.raises(ValueError, match="x"):
        features.assert_finished(df.withColumn("x", F.lit(float("nan"))).select("symbol", "interval", "ts", "x"))
    with pytest.raises(KeyError, match="p_hat"):
        features.backtest_columns(df, "ts", target="close", price="open")


def test_feature_checks(spark):
    df = candles(spark, [100.0])
    with pytest.raises(KeyError, match="close"):
        features.check_inputs(df.drop("close"))
    with pytest.raises(ValueError, match="onch_x"):
        features.check_inputs(df.withColumn("onch_x", F.lit(1.0)))
    with pytest.raises(TypeError, match="open"):
        features.ensure_numeric(df.withColumn("open", F.lit("x")), ["open", "close"])
    assert features.match_contract(df, ["close", "b", "close"]).columns == ["close", "b"]
    assert features.match_column(["a_dxy", "eth"], ["zzz", "dxy"]) == "a_dxy"
    with pytest.raises(ValueError):
        scalars.steps_for(50, 15)


def test_rsi_and_constant_series(spark):
    assert column(candles(spark, [float(i) for i in range(20)]).withColumn("r", windows.rsi(F.col("close"))), "r")[13:] == [100.0] * 7
    assert set(column(candles(spark, [5.0] * 20).withColumn("r", windows.rsi(F.col("close"))), "r")) == {None}


def test_hysteresis_needs_a_width(spark):
    with pytest.raises(ValueError):
        windows.hysteresis(F.col("p"), 0.5, 0.0)


def test_upsert_and_actuals(spark):
    t = "symbol string, interval string, target_time_ms long, p_hat double, prob_move_ge_05 double, y_true_hat double, abs_error double"
    old = spark.createDataFrame([("A", "1h", 1, 1.0, 0.1, 7.0, 6.0)], t)
    new = spark.createDataFrame([("A", "1h", 2, 10.0, 0.25, 1), ("A", "1h", 2, 10.5, 0.75, 2), ("A", "1h", 1, 3.0, 0.2, 1)], "symbol string, interval string, target_time_ms long, p_hat double, prob_move_ge_05 double, n int")
    out = {r.target_time_ms: r for r in tables.upsert(old, new, ["symbol", "interval", "target_time_ms"], ["p_hat", "prob_move_ge_05"], "n").collect()}
    assert (out[2].p_hat, out[2].prob_move_ge_05, out[1].p_hat, out[1].y_true_hat) == (10.5, 0.75, 3.0, 7.0)
    pending = spark.createDataFrame([("A", "1h", 5, 10.0, None, None, None), ("A", "1h", 6, 1.0, None, None, None)], t)
    got = {r.target_time_ms: r for r in timegrid.actuals(pending, spark.createDataFrame([("A", 5, 9.5)], "symbol string, open_time long, close double")).collect()}
    assert (got[5].y_true_hat, got[5].abs_error, got[6].y_true_hat) == (9.5, 0.5, None)


def test_retention(spark):
    day = 86_400_000
    p = spark.createDataFrame([(0, 1.0), (400 * day, 1.0)], "open_time long, open double")
    q = spark.createDataFrame([(1, 0, 1.0), (2, 400 * day, None), (3, 400 * day, 1.0)], "id int, target_time_ms long, y_true_hat double")
    kept = tables.retained(p, "open_time", 400 * day, 365 * day), tables.retained(q, "target_time_ms", 400 * day, 6 * 3_600_000, "y_true_hat")
    assert {r.table: r.deleted for r in tables.deleted_counts({"prices": (p, kept[0]), "predictions": (q, kept[1])}).collect()} == {"prices": 1, "predictions": 2}


def test_payload_shapes(spark):
    texts = [json.dumps({"data": {"points": [[1609459200, "101.5"], [1609460100, 98], [1, None]]}}), json.dumps([{"time": "2021-01-01T00:30:00", "value": 3}]), "garbage", json.dumps({"foo": 1}), None]
    df = spark.createDataFrame([("A", t) for t in texts], "symbol string, payload string")
    assert sorted(r.value for r in payloads.chart_series(df).collect()) == [3.0, 98.0, 101.5]
    d = payloads.difficulty_series(spark.createDataFrame([("A", json.dumps([[1609459200, 100000, 1.0, 1.1], [1609460100, 100001, 1.0, 0.95]]))], "symbol string, payload string")).orderBy("ts").collect()
    assert d[0].height == 100000 and d[1].change == pytest.approx((0.95 - 1.0) * 100)
    fee = payloads.fee_series(spark.createDataFrame([("A", json.dumps([{"time": 1609459200, "p50": 0, "histogram": {"bins": [1, 2, 3], "counts": [1, 1, 2]}}]))], "symbol string, payload string")).first()
    assert (fee.wavg, fee.p50, fee.p90, fee.vsize) == (2.25, 2.0, 3.0, 4.0)


def test_last_point_is_the_last_arrival(spark):
    rows = [("A", 2, json.dumps([[1609459200, 5], [1609459200, 7]])), ("A", 1, json.dumps([[1609459200, 9]]))]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "symbol string, seen int, payload string").repartition(n)
        assert payloads.chart_series(df, arrival="seen").first().value == 7.0


def test_actuals_of_repeated_prices(spark):
    p = spark.createDataFrame([("A", 10, 1.0, None, None)], "symbol string, target_time_ms long, p_hat double, y_true_hat double, abs_error double")
    prices = spark.createDataFrame([("A", 10, 2.0, 2), ("A", 10, 3.0, 1)], "symbol string, open_time long, close double, seen int")
    assert timegrid.actuals(p, prices, "seen").first().y_true_hat == 2.0 and timegrid.actuals(p, prices).first().y_true_hat == 3.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 1.5), ("B", 2, None)], "symbol string, n int, x double")
    tables.write_features(df, f"{tmp_path}/f")
    tables.write_features(df, f"{tmp_path}/f.csv")
    assert sorted(p.name for p in (tmp_path / "f").glob("symbol=*")) == ["symbol=A", "symbol=B"] and spark.read.parquet(f"{tmp_path}/f").count() == 2
    assert scans.file_scan(spark, f"{tmp_path}/f.csv", "when").orderBy("n").first().x == "1.5"
    tables.write_run(str(tmp_path), "r1", {"metrics": df, "folds": df.limit(1)})
    tables.write_run(str(tmp_path), "r1", {"metrics": df})
    assert spark.read.parquet(f"{tmp_path}/metrics").where("run_id = 'r1'").count() == 2 and (tmp_path / "folds" / "run_id=r1").exists()
    tables.write_cv_summary(df, f"{tmp_path}/cv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/cv").count() == 2
    grid = spark.createDataFrame([("2024-01-01", 0, 1.0), ("2024-01-01", 1, 2.0), ("2024-01-02", 2, 3.0)], "date string, hour int, v double")
    tables.overwrite_range(grid, f"{tmp_path}/g")
    tables.overwrite_range(spark.createDataFrame([("2024-01-01", 5, None)], "date string, hour int, v double"), f"{tmp_path}/g")
    assert sorted((r.hour, r.v) for r in spark.read.parquet(f"{tmp_path}/g").collect()) == [(2, 3.0), (5, None)]


def test_live_snapshots_keep_known_cells(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "ts int, a double, b double")
    new = spark.createDataFrame([(1, None), (2, 9.0), (3, 5.0)], "ts int, a double")
    assert sorted(tuple(r) for r in versions.filled_over(old, new, ["ts"]).collect()) == [(1, 1.0, 2.0), (2, 9.0, 4.0), (3, 5.0, None)]


def test_metrics_and_importance_by_regime(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 2.0).alias("a"), (F.hash("id") % 7).cast("double").alias("b"), F.when(F.col("id") < 300, "calm").otherwise("wild").alias("regime"), F.floor(F.col("id") / 100).alias("block"))
    model = models.boosted(df, ["a", "b"], "y", rounds=2, depth=2)
    got = {(r.regime, r.feature): r["mean"] for r in models.importance_by_regime(df, model, ["a", "b"], "y", "id", "regime", repeats=2, block="block").collect()}
    assert set(got) == {(r, f) for r in ("calm", "wild") for f in "ab"} and got["calm", "a"] > 0.3 > abs(got["calm", "b"])
    slow = {r.regime: (r.value, r["count"]) for r in evaluate.by_regime_python(df.withColumnsRenamed({"y": "y_true", "a": "y_pred"}), lambda t, p: ((t - p) ** 2).mean()).collect()}
    assert slow == {"calm": (0.5, 300), "wild": (0.5, 100)}


def test_stratified_splits_and_gaps(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    sizes = {r.y: r.n for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    test = {r.y: r.n for r in splits.stratified_holdout(df, "y", "id").where("role = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert test == {y: round(n * 0.2) for y, n in sizes.items()}
    folds = splits.stratified_kfold(df, "y", "id", 7)
    per = [r.n for r in folds.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()]
    assert folds.count() == 5000 and len(per) == 28 and {(r.id, r.fold) for r in folds.collect()} == {(r.id, r.fold) for r in splits.stratified_kfold(df.repartition(9), "y", "id", 7).collect()}
    t = candles(spark, [1.0] * 300, minutes=45)
    assert [r.g for r in splits.time_gaps(t).distinct().collect()] == [45 * 60 * 1_000_000] and splits.time_gaps(t).count() == 299


def test_grid_and_resample(spark):
    df = spark.createDataFrame([("A", datetime(2021, 1, 1, 0, 15), 1.0), ("A", datetime(2021, 1, 1, 0, 15, 0, 1), 2.0), ("A", datetime(2021, 1, 1, 1, 0), 3.0)], "symbol string, ts timestamp, v double")
    out = [(r.ts.minute, r.hour if "hour" in r else None, r.s) for r in timegrid.resample(df, 900, {"s": F.sum("v")}, empty={"s": 0.0}).orderBy("ts").collect()]
    assert [(m, s) for m, _, s in out] == [(15, 1.0), (30, 2.0), (45, 0.0), (0, 3.0)]
    g = timegrid.grid(spark.createDataFrame([(datetime(2021, 1, 1, 0, 2), datetime(2021, 1, 1, 0, 12))], "start timestamp, end timestamp"), 900)
    assert [r.ts.minute for r in g.orderBy("ts").collect()] == [0, 15]


def test_halo_blocks_give_the_same_windows(spark):
    df = candles(spark, [100.0 + (i * 7 % 5) for i in range(200)])
    w = 10
    whole = column(df.withColumn("m", windows.sma(F.col("close"), w)), "m")
    cut = timegrid.halo_blocks(df, 32, w - 1).withColumn("m", windows.sma(F.col("close"), w, ("symbol", "interval", "_block"))).where("not _halo")
    assert column(cut, "m") == whole


def test_walls_need_six_levels(spark):
    row = spark.createDataFrame([(100.0, [1.0] * 9 + [50.0])], "close double, s array<double>")
    levels = F.transform("s", lambda x, i: F.struct((i + 1).alias("level"), (100.0 - i).alias("price"), x.alias("size")))
    wall = arrays.wall(levels, F.col("close"), "bid")
    d, share = wall["dist_bps"], wall["size_rel"]
    got = row.select(d.alias("d"), share.alias("s")).first()
    assert got.d == pytest.approx(900.0) and got.s == pytest.approx(50 / 59)
    few = spark.createDataFrame([(100.0, [1.0] * 4 + [50.0])], "close double, s array<double>").select(d.alias("d")).first()
    assert few.d is None


def test_conformal_errors(spark):
    df = spark.createDataFrame([(1.0, 1.5)], "y double, p double")
    with pytest.raises(ValueError):
        evaluate.conformal(df, df, "y", "p", "p", alpha=1.5)
    with pytest.raises(ValueError):
        evaluate.conformal(df.where("false"), df, "y", "p", "p")


def test_drop_correlated(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 1.0), (3.0, 6.0, 4.0), (4.0, 8.0, 2.0)], "a double, b double, c double")
    assert drift.drop_correlated(df, ["a", "b", "c"], 0.9) == ["a", "c"]


def test_folds_do_not_overlap(spark):
    df = candles(spark, [float(i) for i in range(200)], minutes=60)
    out = splits.purged_kfold(df, 4, 120).collect()
    for f in {r.fold for r in out}:
        train, test = {r.ts for r in out if r.fold == f and r.role == "train"}, {r.ts for r in out if r.fold == f and r.role == "test"}
        assert test and max(train) < min(test) - timedelta(hours=2)
    folds = splits.walk_forward(T0, T0 + timedelta(days=30), 7, 3, 3, 10, 60, 120, timedelta(hours=1))
    assert all(b <= c - timedelta(hours=1) for _, _, b, c, _ in folds) and all(y[3] >= x[4] + timedelta(hours=2) for x, y in zip(folds, folds[1:], strict=False))


@pytest.fixture(scope="module")
def training(spark):
    rows = [("A", "1h", T0 + timedelta(hours=i), i, (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, id int, a double, b double")
    return df.withColumn("y", ((F.col("a") + 0.1 * F.col("b")) > 0.55).cast("int"))


def test_models(spark, training, tmp_path):
    m = models.trained_with_early_stop(training, ["a", "b"], "y", last_rows=300, rounds=5, depth=3)
    out = models.scored(training, m)
    assert out.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0] > 0.9
    with pytest.raises(KeyError, match="b"):
        models.scored(training.drop("b"), m)
    models.save(m, str(tmp_path / "m"), ["a", "b"], spark=spark, version=1)
    again, meta = models.load(spark, str(tmp_path / "m"))
    assert meta == {"features": ["a", "b"], "version": 1} and models.scored(training, again).select("p").collect() == out.select("p").collect()
    imp = {r.feature: r["mean"] for r in models.permutation_importance(training, m, ["a", "b"], "y", "id", repeats=1).collect()}
    assert imp["a"] > imp["b"]


def test_calibration_does_not_worsen_brier(spark, training):
    df = training.withColumn("p", F.sqrt("a"))
    brier = lambda d, c: d.agg(F.avg(F.pow(F.col(c) - F.col("y"), 2))).first()[0]
    for method in ("isotonic", "sigmoid"):
        out = models.calibrated(df, df, "y", method=method)
        assert brier(out, "calibrated") <= brier(df, "p") + 1e-9
    r = models.rolling_recalibration(df, 50).count()
    assert 300 < r <= 351


def test_walk_forward_and_stacking(spark, training):
    folds = splits.expanding(training, 2)
    out, metrics = models.walk_forward_predictions(folds, ["a", "b"], "y", rounds=3, depth=2)
    assert metrics.count() == 2 and out.count() == metrics.agg(F.sum("count")).first()[0]
    st = models.stacked(training, ["a", "b"], "y")
    assert models.stack_predict(training, st).agg(F.min("p"), F.max("p")).first()[0] >= 0


def run_stream(spark, df, folder, make, mode="append"):
    """Writes ``df`` as files in order of time and runs a query over them to the end; returns its rows."""
    parts = df.orderBy("ts").coalesce(1)
    parts.write.mode("append").parquet(folder)
    with run.rocksdb(spark):
        q = make(spark.readStream.schema(df.schema).parquet(folder)).writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


def test_stream_bars_equal_batch_on_closed_windows(spark, tmp_path):
    ticks = spark.range(2000).select(F.col("id").alias("event_id"), (F.lit(T0).cast("timestamp") + F.expr("make_dt_interval(0,0,0,id*17)")).alias("ts"), (F.col("id") % 13 + 0.5).alias("px"))
    make = lambda t: jobs.bars_stream(t, "10 minutes", "1 minute", F.lit("A"), F.col("px"), F.lit(1))
    got = {r.ts: r for r in run_stream(spark, ticks, str(tmp_path / "t"), make).collect()}
    want = {r.ts: r for r in timegrid.bars(ticks, 600, F.lit("A"), F.col("px"), F.lit(1), F.lit(True)).collect()}
    assert len(want) - 2 <= len(got) <= len(want) and all((g.open, g.high, g.low, g.close, g.volume) == (want[t].open, want[t].high, want[t].low, want[t].close, want[t].volume) for t, g in got.items())


def test_stream_state_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("A", "1h", T0 + timedelta(hours=i), (i * 7 % 10) / 10) for i in range(60)], "symbol string, interval string, ts timestamp, p double")
    got = run_stream(spark, df, str(tmp_path / "s"), lambda t: keyed.in_time_order(t, keyed.ema_step(5), "p", "1 hour")).collect()
    want = {r.ts: r.y for r in windows.ema(df, "p", 5, "y").collect()}
    assert len(got) >= 55 and all(abs(r.out - want[r.ts]) < 1e-9 for r in got)


def test_landing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.createDataFrame([("A", 1, 5.0)], "symbol string, open_time long, close double").write.parquet(path)
    batch = spark.createDataFrame([("A", 1, 6.0, 1), ("A", 2, 7.0, 1), ("A", 2, 8.0, 2)], "symbol string, open_time long, close double, n int")
    land = jobs.landing(lambda: spark.read.parquet(path), lambda d: d.write.mode("append").parquet(path), ["symbol", "open_time"], "n")
    land(batch, 0)
    land(batch, 0)
    assert sorted((r.open_time, r.close) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, 7.0)]


def test_cached_span(spark, tmp_path):
    calls = spark.range(3)
    a = scans.cached_span(calls, str(tmp_path), "x", "2024")
    assert a.count() == 3 and scans.cached_span(spark.range(9), str(tmp_path), "x", "2024").count() == 3
