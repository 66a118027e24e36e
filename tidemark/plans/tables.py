"""Queries on sources, sinks, grids, joins and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import scalars as S
from ..operators import features, timegrid
from ..sources import payloads, scans, tables
from .fixtures import BARS, BARS_15M, BOOK, HIST, PREDS, Inputs
from .registry import query

FROM, TO = 1704153600, 1705276800


def prices(s: Inputs) -> DataFrame:
    return s.bars().withColumn("open_time", F.unix_timestamp("ts") * 1000).drop("ts")


query("src1_price_scan", f"SELECT ts, close, volume, number_of_trades FROM bars WHERE symbol = 'click' AND ts BETWEEN {FROM} AND {TO}", "close volume", "number_of_trades", BARS)(lambda s: scans.price_scan(prices(s), "click", FROM * 1000, TO * 1000).select("ts", "close", "volume", "number_of_trades"))
query("src2_file_scan", "SELECT event_id, value FROM events WHERE value > 10", "value")(lambda s: scans.file_scan(s.spark, f"{s.folder}/events.parquet", "ts").where("value > 10").select("event_id", "value"))


def kline_batch(s: Inputs) -> DataFrame:
    """Half-hour copies of some bars, out of order and repeated, as positional arrays."""
    b = prices(s).where("symbol = 'view'")
    k = F.array(*[F.col(c).cast("string") if c in b.columns else (F.col("open_time") + 3599999).cast("string") for c in ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_base", "taker_buy_quote")])
    rows = b.select(k.alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival")).withColumn("k", F.when(F.col("arrival") == 2, F.transform("k", lambda x, i: F.when(i == 4, F.lit("0")).otherwise(x))).otherwise(F.col("k")))
    return scans.klines(rows, "view", "1h")


def landed(s: Inputs) -> DataFrame:
    target = prices(s).where("symbol = 'view' and number_of_trades % 3 <> 0")
    return tables.insert_or_ignore(target, kline_batch(s), ["symbol", "interval", "open_time"], "arrival").select("symbol", "open_time", "close", "number_of_trades")


query("src3_jn5_landing", "SELECT symbol, ts * 1000 AS open_time, close, number_of_trades FROM bars WHERE symbol = 'view' AND number_of_trades % 3 = 0", "close", "number_of_trades", BARS)(landed)
query("src4_high_water", "SELECT symbol, greatest(max(ts) * 1000 + 1, 1706572800000 - 86400000) AS start_ms, greatest(max(ts) * 1000 + 1, 1706572800000 - 86400000) < 1706572800000 AS due FROM bars GROUP BY symbol", ctes=BARS)(lambda s: scans.next_start(prices(s), 1706572800000, 86400000))
query("src5_chart_series", f"SELECT symbol, ts, round(close, 4) AS value FROM bars WHERE (ts // 86400) IN (SELECT epoch(d)::BIGINT // 86400 FROM (SELECT DISTINCT date_trunc('day', make_timestamp(ts * 1000000)) AS d FROM bars) WHERE day(d) % 10 <> 0) AND ts >= {FROM}", "value", ctes=BARS)(lambda s: payloads.chart_series(s.payload(), start=F.timestamp_seconds(F.lit(FROM))))


def fee_payload(s: Inputs) -> DataFrame:
    """Five-tuples with a zero median at every third bar, and histograms for none."""
    part = F.concat(F.lit("["), F.concat_ws(",", F.unix_timestamp("ts").cast("string"), F.round("close", 4).cast("string"), F.when(F.col("number_of_trades") % 3 == 0, F.lit("0")).otherwise(F.round("low", 4).cast("string")), F.round("high", 4).cast("string"), F.col("number_of_trades").cast("string")), F.lit("]"))
    return s.bars().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.concat(F.lit('{"series":['), F.array_join(F.collect_list(part), ","), F.lit("]}")).alias("payload"))


query("src6_fee_series", "SELECT symbol, ts, round(close, 4) AS wavg, CASE WHEN number_of_trades % 3 <> 0 THEN round(low, 4) END AS p50, round(high, 4) AS p90, CAST(number_of_trades AS DOUBLE) AS vsize FROM bars", "wavg p50 p90 vsize", ctes=BARS)(lambda s: payloads.fee_series(fee_payload(s)))


def difficulty_payload(s: Inputs) -> DataFrame:
    part = F.concat(F.lit("["), F.concat_ws(",", F.unix_timestamp("ts").cast("string"), F.col("number_of_trades").cast("string"), F.round("open", 4).cast("string"), F.when(F.col("number_of_trades") % 4 == 0, F.lit("null")).otherwise(F.round("close", 4).cast("string"))), F.lit("]"))
    return s.bars().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(part), ","), F.lit("]")).alias("payload"))


query("src7_difficulty_series", """SELECT symbol, ts, CAST(number_of_trades AS DOUBLE) AS height, d AS difficulty, coalesce(ch, CASE WHEN last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN can END) AS change FROM (
  SELECT *, CASE WHEN ch IS NOT NULL THEN 1 WHEN can IS NULL THEN 0 END AS m FROM (SELECT *, round(open, 4) AS d, CASE WHEN number_of_trades % 4 <> 0 THEN (round(close, 4) - round(open, 4)) * 100 END AS ch,
  (round(open, 4) - lag(round(open, 4)) OVER (PARTITION BY symbol ORDER BY ts)) / lag(round(open, 4)) OVER (PARTITION BY symbol ORDER BY ts) * 100 AS can FROM bars))""", "height difficulty change", ctes=BARS)(lambda s: payloads.difficulty_series(difficulty_payload(s)))


def snapshots(s: Inputs) -> DataFrame:
    e = s.ticks().where("event_id % 7 = 0")
    text = F.concat(F.lit('{"count": '), F.col("user_id").cast("string"), F.lit(', "economyFee": '), F.col("value").cast("string"), F.lit(', "fee_histogram": [[3.0, 10], [2.0, '), (F.col("event_id") % 30).cast("string"), F.lit("]]}"))
    return payloads.snapshot(e.select(F.col("event_type").alias("symbol"), "event_id", F.col("ts").alias("fetched_at"), text.alias("payload")), 900, ["symbol", "event_id"]).select("symbol", "event_id", "ts", "onch_mempool_count", "onch_fee_min_satvb", "onch_fee_wavg_satvb", "onch_fee_p50_satvb")


query("src8_ts7_snapshot", """SELECT event_type AS symbol, event_id, CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS ts, CAST(user_id AS DOUBLE) AS onch_mempool_count, value AS onch_fee_min_satvb,
 (30 + 2 * (event_id % 30)) / (10 + event_id % 30)::DOUBLE AS onch_fee_wavg_satvb, CASE WHEN event_id % 30 >= 0.5 * (10 + event_id % 30) THEN 2.0 ELSE 3.0 END::DOUBLE AS onch_fee_p50_satvb FROM events WHERE event_id % 7 = 0""", "onch_mempool_count onch_fee_min_satvb onch_fee_wavg_satvb onch_fee_p50_satvb")(snapshots)


def half(s: Inputs, odd: int) -> DataFrame:
    return s.bars().where((F.col("symbol") == "click") & (F.hour("ts") % 3 != odd)).select("ts", F.col("close" if odd else "open").alias("v"), F.col("volume").alias("w"))


query("jn2_src9_outer_on_time", """SELECT coalesce(a.ts, b.ts) AS ts, a.close AS v_x, b.open AS v_y FROM (SELECT * FROM bars WHERE symbol = 'click' AND (ts // 3600) % 24 % 3 <> 1) a
 FULL JOIN (SELECT * FROM bars WHERE symbol = 'click' AND (ts // 3600) % 24 % 3 <> 0) b ON a.ts = b.ts""", "v_x v_y", ctes=BARS)(lambda s: timegrid.outer_on_time(half(s, 1).drop("w"), half(s, 0).drop("w")))
FLOWS = """
flow AS (SELECT coalesce(a.ts, b.ts) AS ts, a.close AS i, b.open AS o FROM (SELECT * FROM bars WHERE symbol = 'click' AND (ts // 3600) % 24 % 3 <> 1) a FULL JOIN (SELECT * FROM bars WHERE symbol = 'click' AND (ts // 3600) % 24 % 3 <> 0) b ON a.ts = b.ts),
got AS (SELECT CAST(ceil(ts / 7200.0) AS BIGINT) * 7200 AS ts, sum(i) AS i, sum(o) AS o, sum(i - o) AS n FROM flow GROUP BY 1),
grid AS (SELECT unnest(range((SELECT min(ts) FROM got), (SELECT max(ts) FROM got) + 1, 7200)) AS ts)"""
query("src10_flows", "SELECT 'all' AS symbol, ts, i AS onch_inflow, o AS onch_outflow, n AS onch_netflow FROM grid LEFT JOIN got USING (ts)", "onch_inflow onch_outflow onch_netflow", ctes=f"{BARS},{FLOWS}")(lambda s: scans.flows(half(s, 1).select(F.col("ts").alias("t"), "v"), half(s, 0).select(F.col("ts").alias("t"), "v"), 7200))
query("src11_transfers", """SELECT 'all' AS symbol, g.ts, coalesce(n, 0) AS count, coalesce(usd, 0) AS usd FROM (SELECT unnest(range((SELECT CAST(ceil(min(epoch(ts)) / 300) AS BIGINT) * 300 FROM events), (SELECT CAST(ceil(max(epoch(ts)) / 300) AS BIGINT) * 300 FROM events) + 1, 300)) AS ts) g
 LEFT JOIN (SELECT CAST(ceil(epoch(ts) / 300) AS BIGINT) * 300 AS ts, count(*) AS n, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END) AS usd FROM events GROUP BY 1) x ON g.ts = x.ts""", "usd", "count")(
    lambda s: scans.transfers(s.ticks().groupBy("user_id").agg(F.collect_list(F.struct("ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("usd"))).alias("transactions")), 300))

PRED = "SELECT symbol, \"interval\", ts * 1000 AS target_time_ms, close AS p_hat, (number_of_trades % 10) / 10.0::DOUBLE AS prob_move_ge_05, CASE WHEN ts % 7200 = 0 THEN close END AS y_true_hat, CASE WHEN ts % 7200 = 0 THEN 0.0::DOUBLE END AS abs_error FROM bars"


def predictions(s: Inputs) -> DataFrame:
    done = F.unix_timestamp("ts") % 7200 == 0
    return s.bars().select("symbol", "interval", (F.unix_timestamp("ts") * 1000).alias("target_time_ms"), F.col("close").alias("p_hat"), (F.col("number_of_trades") % 10 / 10).alias("prob_move_ge_05"), F.when(done, F.col("close")).alias("y_true_hat"), F.when(done, F.lit(0.0)).alias("abs_error"))


def upserted(s: Inputs) -> DataFrame:
    old = predictions(s).where("target_time_ms % 10800000 <> 0")
    new = predictions(s).where("symbol = 'view'").withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("p_hat", F.col("p_hat") + F.col("arrival"))
    return tables.upsert(old, new, ["symbol", "interval", "target_time_ms"], ["p_hat", "prob_move_ge_05"], "arrival")


query("snk2_upsert", f"""SELECT symbol, "interval", target_time_ms, CASE WHEN symbol = 'view' THEN p_hat + 2 ELSE p_hat END AS p_hat, prob_move_ge_05,
 CASE WHEN target_time_ms % 10800000 <> 0 THEN y_true_hat END AS y_true_hat, CASE WHEN target_time_ms % 10800000 <> 0 THEN abs_error END AS abs_error FROM ({PRED}) WHERE symbol = 'view' OR target_time_ms % 10800000 <> 0""", "p_hat prob_move_ge_05 y_true_hat abs_error", ctes=BARS)(upserted)
query("snk3_migration", f"SELECT symbol, \"interval\", target_time_ms, p_hat, CAST(NULL AS DOUBLE) AS prob_move_ge_05, y_true_hat, CAST(NULL AS DOUBLE) AS abs_error FROM ({PRED})", "p_hat prob_move_ge_05 y_true_hat abs_error", ctes=BARS)(
    lambda s: tables.migrate(predictions(s).select("symbol", "interval", "target_time_ms", F.col("p_hat").alias("y_pred"), "y_true_hat", F.lit(1.0).alias("lower_bound"), F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival")), {"symbol": "string", "interval": "string", "target_time_ms": "bigint", "p_hat": "double", "prob_move_ge_05": "double", "y_true_hat": "double", "abs_error": "double"}, {"y_pred": "p_hat"}, ["symbol", "interval", "target_time_ms"], "arrival"))
NOW = 1706400000000


def purged(s: Inputs) -> DataFrame:
    p, q = prices(s), predictions(s)
    return tables.deleted_counts({"prices": (p, tables.retained(p, "open_time", NOW, 10 * 86400000)), "predictions": (q, tables.retained(q, "target_time_ms", NOW, 86400000, "y_true_hat"))})


query("snk4_retention", f"""SELECT 'prices' AS "table", count(*) FILTER (ts * 1000 <= {NOW} - 10 * 86400000) AS deleted FROM bars
 UNION ALL SELECT 'predictions', count(*) FILTER (ts * 1000 <= {NOW} - 86400000 OR ts % 7200 <> 0) FROM bars""", "", "deleted", BARS)(purged)
query("snk5_grid_rows", "SELECT symbol, ts AS ts_utc, CAST(round_even(volume / 2, 0) AS BIGINT) AS onch_mempool_count, close AS onch_fee FROM bars", "onch_fee", ctes=BARS)(lambda s: tables.grid_rows(s.bars().select("symbol", "ts", (F.col("volume") / 2).alias("onch_mempool_count"), F.col("close").alias("onch_fee")), ["onch_mempool_count"]))
query("snk6_evolved", "SELECT symbol, ts, close AS a, CASE WHEN symbol = 'view' THEN open END AS b FROM bars", "a b", ctes=BARS)(lambda s: tables.evolved(s.bars().where("symbol <> 'view'").select("symbol", "ts", F.col("close").alias("a")), s.bars().where("symbol = 'view'").select("symbol", "ts", F.col("close").alias("a"), F.col("open").alias("b"))))

# projections
query("prj2_unparsable", "SELECT count(*) FILTER (TRY_CAST(props AS DOUBLE) IS NULL AND props IS NOT NULL) AS props, 0 AS user_text FROM events", "", "props user_text")(lambda s: features.unparsable(s.ticks().select("props", F.col("user_id").cast("string").alias("user_text")), ["props", "user_text"]))
query("prj4_utc_timestamp", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS parsed FROM events", "", "parsed")(lambda s: s.ticks().select("event_id", S.utc_timestamp(F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.unix_timestamp("ts").cast("string")).when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise("no time")).alias("parsed")))
query("prj5_safe_double", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS v FROM events", "v")(lambda s: s.ticks().select("event_id", S.safe_double(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(F.col("event_id") % 4 == 1, " ").when(F.col("event_id") % 4 == 2, "NaN").otherwise("x1")).alias("v")))
query("prj11_aliases", "SELECT symbol, ts, close AS ret3, close AS mom_ret3, open AS volatility_60m, open AS vol_volatility_60m, high AS atr14, low AS vol_atr14 FROM bars", "ret3 mom_ret3 volatility_60m vol_volatility_60m atr14 vol_atr14", ctes=BARS)(
    lambda s: features.aliases(s.bars().select("symbol", "ts", F.col("close").alias("ret3"), F.col("open").alias("volatility_60m"), F.col("high").alias("atr14"), F.col("low").alias("vol_atr14")), features.ALIASES))
query("prj13_contract", "SELECT symbol, ts, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close, 0.5::DOUBLE AS missing, CAST(CAST(open AS FLOAT) AS DOUBLE) AS open FROM bars", "close missing open", ctes=BARS)(lambda s: features.match_contract(s.bars(), ["close", "missing", "open", "close"], 0.5, keep=["symbol", "ts"]))
query("prj14_backtest_columns", "SELECT symbol, ts AS timestamp, target, last_price FROM preds", "target last_price", ctes=f"{BARS},{PREDS}")(lambda s: features.backtest_columns(s.preds(), "ts").select("symbol", "timestamp", "target", "last_price"))
NAMES = "SELECT DISTINCT name FROM (SELECT unnest(['tbr_', 'mom_ret_', 'onch_', 'lob_', 'cross_ret_', 'volume_', 'time_']) || event_type AS name FROM events)"
query("prj15_feature_groups", f"""SELECT name, CASE WHEN regexp_matches(name, '^tbr_|^ofi_|^cvd_|^taker_|rel_close_vwap|z_volume') THEN 'orderflow' WHEN regexp_matches(name, '^oi_|^basis_|^funding_|^deriv_') THEN 'derivatives' WHEN regexp_matches(name, '^lob_|^queue_|book_slope|^wall_') THEN 'lob'
 WHEN regexp_matches(name, 'ret|^volatility_|^atr_|skew|kurt') THEN 'momentum_vol' WHEN regexp_matches(name, '^tod_|^session_|funding_cycle|^dow_|^time_') THEN 'time' WHEN regexp_matches(name, '^onch_') THEN 'onchain' WHEN regexp_matches(name, '^cross_') THEN 'cross_asset' ELSE 'other' END AS "group" FROM ({NAMES})""")(
    lambda s: s.ticks().select("event_type").distinct().select(F.explode(F.array(*map(F.lit, ["tbr_", "mom_ret_", "onch_", "lob_", "cross_ret_", "volume_", "time_"]))).alias("p"), "event_type").select(F.concat("p", "event_type").alias("name")).withColumn("group", S.feature_group(F.col("name"))))
query("scl1_interval_minutes", "SELECT symbol, \"interval\", 60 AS minutes, count(*) AS n FROM bars GROUP BY ALL", "", "minutes n", BARS)(lambda s: s.bars().groupBy("symbol", "interval").agg(F.count("*").alias("n")).withColumn("minutes", S.minutes_of(F.col("interval"))))
query("scl2_minutes_label", "SELECT event_id, CASE WHEN m % 1440 = 0 THEN (m // 1440) || 'd' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE m || 'm' END AS label FROM (SELECT event_id, (event_id % 200 + 1) * 15 AS m FROM events)")(lambda s: s.ticks().select("event_id", S.minutes_label((F.col("event_id") % 200 + 1) * 15).alias("label")))
query("fil1_range", f"SELECT event_id FROM events WHERE epoch(ts) BETWEEN {FROM} AND {TO}")(lambda s: s.ticks().where(F.col("ts").between(F.timestamp_seconds(F.lit(FROM)), F.timestamp_seconds(F.lit(TO)))).select("event_id"))

# arrays
query("arr2_weighted_mean", "SELECT l_orderkey, sum(rate * size) / sum(size) AS wavg FROM hist GROUP BY 1", "wavg", ctes=HIST)(lambda s: s.hist().select("l_orderkey", arrays.weighted_mean(F.col("hist")).alias("wavg")))
query("arr3_weighted_percentile", "SELECT l_orderkey, min(rate) FILTER (c >= 0.5 * t) AS p50, min(rate) FILTER (c >= 0.9 * t) AS p90 FROM (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY rate, size) AS c, sum(size) OVER (PARTITION BY l_orderkey) AS t FROM hist) GROUP BY 1", "p50 p90", ctes=HIST)(lambda s: s.hist().select("l_orderkey", arrays.weighted_percentile(F.col("hist"), 0.5).alias("p50"), arrays.weighted_percentile(F.col("hist"), 0.9).alias("p90")))
query("arr4_zipped_histogram", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, sum(size) AS w FROM hist GROUP BY 1", "w", "n", HIST)(lambda s: s.hist().select("l_orderkey", arrays.zipped_histogram(F.transform("hist", lambda x: x.rate), F.concat(F.transform("hist", lambda x: x["size"]), F.array(F.lit(7.0)))).alias("h")).select("l_orderkey", F.size("h").alias("n"), arrays.summed(F.col("h"), lambda x: x["size"]).alias("w")))


def booked(s: Inputs) -> DataFrame:
    return features.order_book(s.book())


WALL = """, st AS (SELECT k, y, side, avg(size) AS m, stddev_pop(size) AS d, sum(size) AS t FROM levels GROUP BY ALL),
w AS (SELECT k, y, side, arg_min(price, n * 1.0 - size * 1000) AS price, max(size) AS size, any_value(t) AS t FROM levels JOIN st USING (k, y, side) WHERE size > m + 2 * d GROUP BY ALL)"""
query("arr1_7_walls", "SELECT s.k, s.y, (s.close - a.price) / s.close * 1e4 AS wall_bid_dist_bps, a.size / a.t AS wall_bid_size_rel, (b.price - s.close) / s.close * 1e4 AS wall_ask_dist_bps, b.size / b.t AS wall_ask_size_rel FROM snaps s LEFT JOIN w a ON s.k = a.k AND s.y = a.y AND a.side = 'bid' LEFT JOIN w b ON s.k = b.k AND s.y = b.y AND b.side = 'ask'", "wall_bid_dist_bps wall_bid_size_rel wall_ask_dist_bps wall_ask_size_rel", "k y", BOOK + WALL)(lambda s: booked(s).select("k", "y", "wall_bid_dist_bps", "wall_bid_size_rel", "wall_ask_dist_bps", "wall_ask_size_rel"))
query("arr5_scl9_10_depth_spread", "SELECT k, y, (bids - asks) / nullif(bids + asks, 0) AS lob_depth_imbalance, (ask1 - bid1) / nullif((ask1 + bid1) / 2, 0) * 1e4 AS lob_spread_bps FROM snaps", "lob_depth_imbalance lob_spread_bps", "k y", BOOK)(lambda s: booked(s).select("k", "y", "lob_depth_imbalance", "lob_spread_bps"))
SLOPE = "(sum(price * size) FILTER (side = '{0}') / sum(size) FILTER (side = '{0}') - any_value({0}1)) / any_value({0}1) * 1e4 AS lob_{0}_slope_bps"
query("arr6_slope", f"SELECT k, y, {SLOPE.format('bid')}, {SLOPE.format('ask')} FROM levels JOIN snaps USING (k, y) GROUP BY k, y", "lob_bid_slope_bps lob_ask_slope_bps", "k y", BOOK)(lambda s: booked(s).select("k", "y", "lob_bid_slope_bps", "lob_ask_slope_bps"))


def level_imbalance(s: Inputs) -> DataFrame:
    first = {f"lob_{side}_L{n}": F.col(f"lob_{side}_size_{n}") for side in ("bid", "ask") for n in (1, 2)}
    return features.order_book(s.book().withColumns(first)).select("k", "y", "lob_imbalance_L1", "lob_imbalance_L2")


IMBALANCE = "(max(size) FILTER (side = 'bid' AND n = {0}) - max(size) FILTER (side = 'ask' AND n = {0})) / nullif(max(size) FILTER (side = 'bid' AND n = {0}) + max(size) FILTER (side = 'ask' AND n = {0}), 0) AS lob_imbalance_L{0}"
query("scl9_level_imbalance", f"SELECT k, y, {IMBALANCE.format(1)}, {IMBALANCE.format(2)} FROM levels GROUP BY k, y", "lob_imbalance_L1 lob_imbalance_L2", "k y", BOOK)(level_imbalance)


def matched(s: Inputs) -> DataFrame:
    """Which column of a table each list of candidates takes: the first candidate that any column holds."""
    t = s.deriv().withColumnRenamed("funding_rate", "Perp_Funding_Rate")
    names = {"funding": features.FUNDING, "long": features.LIQ_LONG, "short": features.LIQ_SHORT, "gold": features.CROSS_ASSETS["gold"]}
    return t.groupBy("symbol").agg(F.count("*").alias("n"), *[F.lit(features.match_column(t.columns, c)).cast("string").alias(k) for k, c in names.items()])


query("prj9_matched_columns", "SELECT symbol, count(*) AS n, 'Perp_Funding_Rate' AS funding, 'liq_long' AS long, 'liq_short' AS short, CAST(NULL AS VARCHAR) AS gold FROM bars GROUP BY symbol", "", "n", BARS)(matched)
query("ts2_rows_for", "SELECT symbol, \"interval\", 60 AS step_minutes, m AS minutes, CAST(greatest(1, round_even(m / 60.0, 0)) AS BIGINT) AS n, m >= 60 AS supported FROM (SELECT DISTINCT symbol, \"interval\" FROM bars), (SELECT unnest([15, 60, 240, 1440]) AS m)", "", "step_minutes minutes", BARS)(
    lambda s: timegrid.step_minutes(s.bars()).select("symbol", "interval", "step_minutes", F.inline(F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(timegrid.rows_for(m, 60)).cast("long").alias("n"), F.lit(m >= 60).alias("supported")) for m in features.TIMEFRAMES]))))

# time grid
query("ts1_step_minutes", "SELECT symbol, \"interval\", greatest(round_even(median(g), 0), 1)::BIGINT AS step_minutes FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 60.0 AS g FROM bars_15m) WHERE g IS NOT NULL GROUP BY ALL", ctes=BARS_15M)(lambda s: timegrid.step_minutes(s.bars_15m()))
query("ts3_grid", "SELECT symbol, unnest(range(CAST(floor(a / 900) AS BIGINT) * 900, CAST(ceil(b / 900) AS BIGINT) * 900 + 1, 900)) AS ts FROM (SELECT event_type AS symbol, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events GROUP BY 1)")(lambda s: timegrid.grid(s.ticks().groupBy(F.col("event_type").alias("symbol")).agg(F.min("ts").alias("start"), F.max("ts").alias("end")), 900))
RES = """got AS (SELECT event_type AS symbol, CAST(ceil(epoch(ts) / 1800) AS BIGINT) * 1800 AS ts, sum(value) AS s, median(value) AS m, count(*) AS n FROM events GROUP BY 1, 2),
grid AS (SELECT symbol, unnest(range(min(ts), max(ts) + 1, 1800)) AS ts FROM got GROUP BY symbol)"""
query("ts4_resample", "SELECT symbol, ts, coalesce(s, 0) AS total, m AS middle, coalesce(n, 0) AS n FROM grid LEFT JOIN got USING (symbol, ts)", "total middle", "n", RES)(lambda s: timegrid.resample(s.ticks().withColumnRenamed("event_type", "symbol"), 1800, {"total": F.sum("value"), "middle": F.median("value"), "n": F.count("*")}, empty={"total": 0.0, "n": 0}))
query("ts6_align", "SELECT g.ts, b.close FROM (SELECT unnest(range((SELECT min(ts) FROM bars_15m), (SELECT max(ts) FROM bars_15m) + 1, 1800)) AS ts) g LEFT JOIN bars_15m b ON g.ts = b.ts", "close", ctes=BARS_15M)(
    lambda s: timegrid.align(s.bars_15m().select("ts", "close", F.col("ts").alias("arrival")), s.bars_15m().agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1800 seconds"))).alias("ts"))))
query("ded1_keep_last", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id", "", "event_id")(lambda s: timegrid.keep_last(s.ticks(), ["user_id"], "ts").select("user_id", "event_id"))
MERGE = "SELECT g.ts, coalesce(CASE WHEN v.number_of_trades % 2 = 0 THEN v.close END, c.close) AS x, v.volume AS y FROM (SELECT DISTINCT ts FROM bars) g LEFT JOIN (SELECT * FROM bars WHERE symbol = 'click') c USING (ts) LEFT JOIN (SELECT * FROM bars WHERE symbol = 'view') v USING (ts)"
query("jn1_merge_sources", MERGE, "x y", ctes=BARS)(lambda s: timegrid.merge_sources(s.bars().select("ts").distinct(), [s.bars().where("symbol = 'click'").select("ts", F.col("close").alias("x")), s.bars().where("symbol = 'view'").select("ts", F.when(F.col("number_of_trades") % 2 == 0, F.col("close")).alias("x"), F.col("volume").alias("y"))]))
query("jn3_4_actuals", f"""SELECT p.symbol, p."interval", p.target_time_ms, p.p_hat + 1 AS p_hat, p.prob_move_ge_05, CASE WHEN p.target_time_ms % 7200000 = 0 THEN p.y_true_hat WHEN b.number_of_trades % 3 <> 0 THEN b.close END AS y_true_hat,
 CASE WHEN p.target_time_ms % 7200000 = 0 THEN p.abs_error WHEN b.number_of_trades % 3 <> 0 THEN abs(p.p_hat + 1 - b.close) END AS abs_error FROM ({PRED}) p JOIN bars b ON p.symbol = b.symbol AND p.target_time_ms = b.ts * 1000""", "p_hat prob_move_ge_05 y_true_hat abs_error", ctes=BARS)(lambda s: timegrid.actuals(predictions(s).withColumn("p_hat", F.col("p_hat") + 1), prices(s).where("number_of_trades % 3 <> 0")))
query("jn7_as_of_hour", """SELECT e.event_type AS symbol, e.event_id, (SELECT arg_max(b.event_id, b.ts) FROM events b WHERE b.event_type = e.event_type AND b.ts <= e.ts AND date_trunc('hour', b.ts) = date_trunc('hour', e.ts) AND b.event_id % 3 = 0) AS snap FROM events e""", "", "event_id snap")(
    lambda s: timegrid.as_of_hour(s.ticks().select(F.col("event_type").alias("symbol"), "ts", "event_id"), s.ticks().where("event_id % 3 = 0").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("snap")), ["snap"]).select("symbol", "event_id", "snap"))
query("set1_union", "SELECT symbol, ts, close AS p, 'a' AS model FROM bars UNION ALL SELECT symbol, ts, open, 'b' FROM bars", "p", ctes=BARS)(lambda s: s.bars().select("symbol", "ts", F.col("close").alias("p"), F.lit("a").alias("model")).unionByName(s.bars().select("symbol", "ts", F.col("open").alias("p"), F.lit("b").alias("model"))))
query("srt1_chronological", "SELECT symbol, ts, close FROM bars ORDER BY symbol, ts", "close", ctes=BARS)(lambda s: s.bars().select("symbol", "ts", "close").orderBy("symbol", "ts"))
