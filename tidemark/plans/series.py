"""Queries on bars: scalars, windows, features, labels, signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.rolling import correlation, delta, deviation, mean, series, total, z_score
from ..operators import barriers, features, labels, signals, windows
from .fixtures import BARS, BARS_15M, BARS_MINUTE, BARS_ZERO, DERIV, JOINED, Inputs
from .registry import query

KEYS = ["symbol", "ts"]


class Lazy:
    """Columns and the window of a series, made when they are asked for: modules are imported before there is a session."""

    NAMES = {"C": "close", "V": "volume", "Q": "quote_asset_volume", "TB": "taker_buy_base", "TQ": "taker_buy_quote"}

    def __getattr__(self, name: str):
        return series() if name == "BY" else F.col(self.NAMES[name])


X = Lazy()
P = "PARTITION BY symbol ORDER BY ts"


def rows(w: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, w: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {rows(w)} >= {w if least is None else least} THEN {agg}({x}) {rows(w)} END"


def on_bars(name: str, outputs: Callable[[], dict], sql: dict[str, str], source: str = "bars", ctes: str = BARS, base: dict[str, str] | None = None) -> None:
    """One query whose outputs are column expressions over a series, with its twin."""

    def run(s: Inputs) -> DataFrame:
        df = getattr(s, source)()
        return df.select(*KEYS, *[(c() if callable(c) else c).alias(n) for n, c in outputs().items()])

    inner = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in base.items())} FROM {source})" if base else source
    query(name, f"SELECT symbol, ts, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {inner}", " ".join(sql), ctes=ctes)(run)


query("ts5_bars_1h", "SELECT * FROM bars", "open high low close volume quote_asset_volume taker_buy_base taker_buy_quote", "number_of_trades", BARS)(lambda s: s.bars())
query("ts5_bars_15m", "SELECT * FROM bars_15m", "open high low close volume quote_asset_volume", "number_of_trades", BARS_15M)(lambda s: s.bars_15m().drop("taker_buy_base", "taker_buy_quote"))

HOUR, MINUTE, DAY = "(ts // 3600 % 24)", "(ts // 60 % 1440)", "((ts // 86400 + 3) % 7)"
on_bars("scl3_4_time_features", lambda: S.time_features(F.col("ts")), {
    **{f"{n}_{f}": f"{f}({v} * (2 * pi() / {k}))" for n, v, k in (("tod", MINUTE, 1440), ("time_hour", HOUR, 24), ("time_dow", DAY, 7)) for f in ("sin", "cos")},
    "is_day": f"CAST({HOUR} >= 8 AND {HOUR} < 20 AS DOUBLE)", "is_night": f"CAST(NOT ({HOUR} >= 8 AND {HOUR} < 20) AS DOUBLE)",
    "is_weekend": f"CAST({DAY} >= 5 AS DOUBLE)", "is_weekday": f"CAST({DAY} < 5 AS DOUBLE)",
})
ZERO = f"{BARS},{BARS_ZERO}"
on_bars("scl5_order_flow", lambda: {"tbr_base": S.taker_flow(X.TB, X.V)[0], "ofi_base": S.taker_flow(X.TB, X.V)[1], "ofi_quote": S.taker_flow(X.TQ, X.Q)[1]}, {"tbr_base": "taker_buy_base / nullif(volume, 0)", "ofi_base": "2 * (taker_buy_base / nullif(volume, 0)) - 1", "ofi_quote": "2 * (taker_buy_quote / nullif(quote_asset_volume, 0)) - 1"}, "bars_zero", ZERO)
on_bars("scl6_vwap_distance", lambda: {"rel_close_vwap": S.vwap_distance(X.C, X.Q, X.V)}, {"rel_close_vwap": "abs(close - quote_asset_volume / nullif(volume, 0)) / nullif(quote_asset_volume / nullif(volume, 0), 0)"}, "bars_zero", ZERO)
on_bars("scl7_taker_buy_sell", lambda: {"ratio": S.taker_buy_sell(X.TB, X.V)}, {"ratio": "taker_buy_base / nullif(volume - taker_buy_base, 0)"}, "bars_zero", ZERO)
on_bars("scl8_liquidations", lambda: S.liquidation(F.col("liq_long"), F.col("liq_short"), F.col("open_interest")), {"deriv_liq_total": "liq_long + liq_short", "deriv_liq_net": "liq_long - liq_short", "deriv_liq_to_oi": "(liq_long + liq_short) / nullif(open_interest, 0)"}, "deriv", f"{BARS},{DERIV}")

on_bars("win1_sma", lambda: {"sma14": windows.sma(X.C)}, {"sma14": full("avg", "close", 14)})
RSI_BASE = {"ch": f"coalesce(close - lag(close) OVER ({P}), 0)"}
UP, DOWN = full("avg", "greatest(ch, 0)", 14), full("avg", "greatest(-ch, 0)", 14)
on_bars("win3_rsi", lambda: {"rsi14": windows.rsi(X.C)}, {"rsi14": f"CASE WHEN {DOWN} > 0 THEN 100 - 100 / (1 + ({UP}) / ({DOWN})) WHEN {UP} > 0 THEN 100 END"}, base=RSI_BASE)
on_bars("win4_delta", lambda: {"d_tbr_base": lambda: delta(S.taker_flow(X.TB, X.V)[0], X.BY)}, {"d_tbr_base": f"t - lag(t) OVER ({P})"}, "bars_zero", ZERO, {"t": "taker_buy_base / nullif(volume, 0)"})
on_bars("win5_z_volume", lambda: {"z_volume": z_score(F.nullif(X.V, F.lit(0.0)), 36, X.BY)}, {"z_volume": f"(v - ({full('avg', 'v', 36)})) / nullif({full('stddev_samp', 'v', 36)}, 0)"}, base={"v": "nullif(volume, 0)"})
FLOW = {"ofi_base": (lambda: S.taker_flow(X.TB, X.V)[1]), "ofi_quote": (lambda: S.taker_flow(X.TQ, X.Q)[1]), "tbr_base": (lambda: S.taker_flow(X.TB, X.V)[0])}
FLOW_SQL = {"ofi_base": "2 * (taker_buy_base / nullif(volume, 0)) - 1", "ofi_quote": "2 * (taker_buy_quote / nullif(quote_asset_volume, 0)) - 1", "tbr_base": "taker_buy_base / nullif(volume, 0)"}
on_bars("win6_flow_means", lambda: {f"{c}_roll_{tf}": mean(f(), w, X.BY) for c, f in FLOW.items() for tf, w in (("1h", 1), ("4h", 4), ("1d", 24))}, {f"{c}_roll_{tf}": full("avg", c, w) for c in FLOW for tf, w in (("1h", 1), ("4h", 4), ("1d", 24))}, base=FLOW_SQL)


def log_return(s: DataFrame) -> DataFrame:
    return s.withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(X.BY))


RETURNS = f"{BARS},{BARS_ZERO},\nret AS (SELECT *, lc - lag(lc) OVER ({P}) AS r FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lc FROM bars_zero))"
query("win7_ret3", f"SELECT symbol, ts, {full('sum', 'r', 3)} AS ret3 FROM ret", "ret3", ctes=RETURNS)(lambda s: log_return(s.bars_zero()).select(*KEYS, total(F.col("r"), 3, X.BY).alias("ret3")))
query("win8_log_returns", f"SELECT symbol, ts, lc - lag(lc, 4) OVER ({P}) AS mom_log_ret_4h, lc - lag(lc, 24) OVER ({P}) AS mom_log_ret_1d FROM ret", "mom_log_ret_4h mom_log_ret_1d", ctes=RETURNS)(lambda s: s.bars_zero().select(*KEYS, *[(F.ln("close") - F.lag(F.ln("close"), w).over(X.BY)).alias(f"mom_log_ret_{t}") for t, w in (("4h", 4), ("1d", 24))]))
query("win9_13_realised_volatility", f"SELECT symbol, ts, {full('stddev_samp', 'r', 4)} AS vol_realized_4h, {full('stddev_samp', 'r', 24)} AS vol_realized_1d, {full('stddev_samp', 'r', 12)} AS volatility_60m FROM ret", "vol_realized_4h vol_realized_1d volatility_60m", ctes=RETURNS)(lambda s: log_return(s.bars_zero()).select(*KEYS, *[deviation(F.col("r"), w, X.BY).alias(n) for n, w in (("vol_realized_4h", 4), ("vol_realized_1d", 24), ("volatility_60m", 12))]))
query("win10_vol_of_vol", f"SELECT symbol, ts, {full('stddev_samp', 'v', 4)} AS vol_of_vol_4h FROM (SELECT *, {full('stddev_samp', 'r', 4)} AS v FROM ret)", "vol_of_vol_4h", ctes=RETURNS)(lambda s: log_return(s.bars_zero()).withColumn("v", deviation(F.col("r"), 4, X.BY)).select(*KEYS, deviation(F.col("v"), 4, X.BY).alias("vol_of_vol_4h")))
on_bars("win11_parkinson", lambda: {"vol_range_parkinson_1d": lambda: F.sqrt(mean(F.pow(F.ln(F.try_divide("high", F.col("low"))), 2), 24, X.BY) / (4 * 0.6931471805599453))}, {"vol_range_parkinson_1d": f"sqrt(({full('avg', 'x', 24)}) / (4 * ln(2)))"}, base={"x": "ln(high / nullif(low, 0)) ** 2"})
on_bars("win14_true_range", lambda: {"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(X.BY)), F.abs(F.col("low") - F.lag("close").over(X.BY)))}, {"tr": f"greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P})))"})
query("win14_atr14", f"SELECT symbol, ts, {full('avg', 'tr', 14)} AS atr14 FROM (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS tr FROM bars)", "atr14", ctes=BARS)(lambda s: features.momentum(s.bars(), 60).select(*KEYS, "atr14"))
DER = f"{BARS},{DERIV}"
query("win15_17_derivatives", f"""SELECT symbol, ts, open_interest - lag(open_interest, 3) OVER ({P}) AS oi_delta_15m, open_interest - lag(open_interest, 1) OVER ({P}) AS deriv_oi_velocity,
 open_interest / nullif(lag(open_interest) OVER ({P}), 0) - 1 AS deriv_oi_change_pct, funding_rate - lag(funding_rate) OVER ({P}) AS deriv_funding_rate_change, {full('avg', 'funding_rate', 4)} AS deriv_funding_rate_smooth,
 basis_annualized - ({full('avg', 'basis_annualized', 4)}) AS deriv_basis_trend, basis_annualized - lag(basis_annualized, 4) OVER ({P}) AS deriv_basis_slope FROM deriv""", "oi_delta_15m deriv_oi_velocity deriv_oi_change_pct deriv_funding_rate_change deriv_funding_rate_smooth deriv_basis_trend deriv_basis_slope", ctes=DER)(lambda s: features.derivatives(s.deriv(), 60).select(*KEYS, "oi_delta_15m", "deriv_oi_velocity", "deriv_oi_change_pct", "deriv_funding_rate_change", "deriv_funding_rate_smooth", "deriv_basis_trend", "deriv_basis_slope"))


def crossed(s: Inputs) -> DataFrame:
    b = s.bars()
    other = b.where("symbol = 'click'").select("ts", F.col("close").alias("ethbtc_close"))
    return features.cross_assets(b.where("symbol = 'view'").join(other, "ts"), {"ethbtc": "ethbtc_close"}, 60)


query("win18_cross_asset", f"""SELECT symbol, ts, y AS cross_ethbtc_ret, x - y AS cross_ethbtc_divergence,
 CASE WHEN count(x + y) {rows(4)} = 4 AND max(x) {rows(4)} > min(x) {rows(4)} AND max(y) {rows(4)} > min(y) {rows(4)} THEN corr(x, y) {rows(4)} END AS cross_ethbtc_corr_4h
 FROM (SELECT a.symbol, a.ts, ln(a.close) - lag(ln(a.close)) OVER (ORDER BY a.ts) AS x, ln(b.close) - lag(ln(b.close)) OVER (ORDER BY a.ts) AS y FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol = 'view' AND b.symbol = 'click')""", "cross_ethbtc_ret cross_ethbtc_divergence cross_ethbtc_corr_4h", ctes=BARS)(lambda s: crossed(s).select(*KEYS, "cross_ethbtc_ret", "cross_ethbtc_divergence", "cross_ethbtc_corr_4h"))
query("win19_hour_fill", """SELECT symbol, ts, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol, ts // 3600 ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS onch_mempool_count
 FROM (SELECT *, CASE WHEN number_of_trades % 3 <> 0 THEN CAST(number_of_trades AS DOUBLE) END AS x FROM bars_15m)""", "onch_mempool_count", ctes=BARS_15M)(lambda s: s.bars_15m().select(*KEYS, windows.hour_fill(F.when(F.col("number_of_trades") % 3 != 0, F.col("number_of_trades").cast("double")), 12, fill=0.0).alias("onch_mempool_count")))
query("win20_chained_change", f"""SELECT symbol, ts, coalesce(ch, CASE WHEN last_value(m IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN can END) AS ch
 FROM (SELECT *, CASE WHEN ch IS NOT NULL THEN 1 WHEN can IS NULL THEN 0 END AS m FROM (SELECT *, CASE WHEN number_of_trades % 4 = 0 THEN open - 100 END AS ch, (close - lag(close) OVER ({P})) / nullif(lag(close) OVER ({P}), 0) * 100 AS can FROM bars_zero))""", "ch", ctes=ZERO)(lambda s: windows.chained_change(s.bars_zero().withColumn("ch", F.when(F.col("number_of_trades") % 4 == 0, F.col("open") - 100)), "close", "ch").select(*KEYS, "ch"))
query("win21_z_and_delta", f"""SELECT symbol, ts, (mom - ({full('avg', 'mom', 36)})) / nullif({full('stddev_samp', 'mom', 36)}, 0) AS z_mom, mom - lag(mom) OVER ({P}) AS d_mom FROM (SELECT *, ln(close) - lag(ln(close), 4) OVER ({P}) AS mom FROM bars)""", "z_mom d_mom", ctes=BARS)(lambda s: features.z_and_delta(s.bars().withColumn("mom", F.ln("close") - F.lag(F.ln("close"), 4).over(X.BY)), ["mom"]).select(*KEYS, "z_mom", "d_mom"))
query("win22_volatility_regime", f"""SELECT symbol, ts, volatility, CASE WHEN volatility <= lo THEN 'calm' WHEN volatility >= hi THEN 'volatile' ELSE 'neutral' END AS regime FROM (
 SELECT *, quantile_cont(volatility, 0.3) OVER (PARTITION BY symbol) AS lo, quantile_cont(volatility, 0.7) OVER (PARTITION BY symbol) AS hi FROM (
 SELECT symbol, ts, first_value(v IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS volatility FROM (
 SELECT *, {full('stddev_samp', 'c', 24, 12)} AS v FROM (SELECT *, coalesce(close / lag(close) OVER ({P}) - 1, 0) AS c FROM bars))))""", "volatility", ctes=BARS)(lambda s: windows.volatility_regime(s.bars()).select(*KEYS, "volatility", "regime"))
query("win23_hysteresis", f"""SELECT symbol, ts, coalesce(last_value(CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.3 THEN 0 END IGNORE NULLS) OVER ({P}), 0) AS signal FROM (SELECT *, (number_of_trades % 10) / 10.0::DOUBLE AS p FROM bars)""", "", "signal", BARS)(lambda s: s.bars().select(*KEYS, windows.hysteresis(F.col("number_of_trades") % 10 / 10, 0.6, 0.3).alias("signal")))
query("win24_span_mean", "SELECT symbol, ts, avg(ln(close)) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW) AS mean_7d FROM bars", "mean_7d", ctes=BARS)(lambda s: s.bars().select(*KEYS, windows.span_mean(F.ln(X.C), 7).alias("mean_7d")))
query("win25_sequences", f"""SELECT symbol, ts, CAST(CAST(a AS FLOAT) AS DOUBLE) AS first_close, CAST(CAST(b AS FLOAT) AS DOUBLE) AS last_close, l AS label, 8 AS n FROM (SELECT symbol, ts, lag(close, 7) OVER ({P}) AS a, close AS b, lead(close, 2) OVER ({P}) AS l FROM bars) WHERE a IS NOT NULL AND l IS NOT NULL""", "first_close last_close label", "n", BARS)(lambda s: windows.sequences(s.bars(), ["close", "open"], "close", 8, 2).select(*KEYS, F.col("sequence")[0][0].alias("first_close"), F.col("sequence")[7][0].alias("last_close"), "label", F.size("sequence").alias("n")))
query("win26_decay_weight", "SELECT symbol, ts, exp((max(ts) OVER (PARTITION BY symbol) - ts) / 86400.0::DOUBLE * (-0.6931471805599453::DOUBLE / 7)) AS weight FROM bars", "weight", ctes=BARS)(lambda s: s.bars().select(*KEYS, windows.decay_weight(7.0).alias("weight")))
EMA = f"""{BARS},
ord AS (SELECT symbol, ts, CASE WHEN number_of_trades % 5 <> 0 THEN close END AS x, row_number() OVER ({P}) AS n FROM bars),
ema AS (
  SELECT symbol, ts, n, x AS y, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS g FROM ord WHERE n = 1
  UNION ALL
  SELECT o.symbol, o.ts, o.n, CASE WHEN o.x IS NULL THEN e.y WHEN e.y IS NULL THEN o.x
    ELSE (e.y * (11.0::DOUBLE / 13) ** e.g + o.x * (2.0::DOUBLE / 13)) / ((11.0::DOUBLE / 13) ** e.g + 2.0::DOUBLE / 13) END,
    CASE WHEN o.x IS NULL THEN e.g + 1 ELSE 1 END
  FROM ema e JOIN ord o ON o.symbol = e.symbol AND o.n = e.n + 1)"""
query("win2_ema", "SELECT symbol, ts, y AS ema12 FROM ema", "ema12", ctes=EMA)(lambda s: windows.ema(s.bars().withColumn("x", F.when(F.col("number_of_trades") % 5 != 0, X.C)), "x", 12, "ema12").select(*KEYS, "ema12"))
TREND = f"""{BARS},
ord AS (SELECT symbol, ts, close AS x, row_number() OVER ({P}) AS n FROM bars),
ema AS (SELECT symbol, ts, n, x, x AS f, x AS s FROM ord WHERE n = 1
  UNION ALL SELECT o.symbol, o.ts, o.n, o.x, e.f / 3 + o.x * 2 / 3, e.s * (3.0::DOUBLE / 5) + o.x * (2.0::DOUBLE / 5) FROM ema e JOIN ord o ON o.symbol = e.symbol AND o.n = e.n + 1)"""
query("win12_microtrend", "SELECT symbol, ts, (f - s) / nullif(x, 0) AS mom_microtrend_ema_ratio FROM ema", "mom_microtrend_ema_ratio", ctes=TREND)(lambda s: features.momentum(s.bars(), 60).select(*KEYS, "mom_microtrend_ema_ratio"))
query("prj6_7_finished_floats", f"SELECT symbol, \"interval\", ts, CAST(coalesce(CAST(open - lag(open, 3) OVER ({P}) AS FLOAT), -1) AS DOUBLE) AS d3 FROM bars", "d3", ctes=BARS)(lambda s: features.finished(s.bars().select("symbol", "interval", "ts", delta(F.col("open"), X.BY, 3).alias("d3")), ["symbol", "interval", "ts"], -1.0))
query("features_all")(lambda s: features.create_features(s.joined()))
GAPS = BARS_MINUTE + EMA[len(BARS) :].replace("number_of_trades % 5 <> 0", "i NOT BETWEEN 30 AND 29 + least(6000, c // 2)").replace(f"row_number() OVER ({P}) AS n FROM bars", f"i AS n FROM (SELECT *, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bars_min)")
query("win2_ema_long_gaps", "SELECT symbol, ts, y AS ema12 FROM ema", "ema12", ctes=GAPS)(lambda s: windows.ema(s.gapped(), "x", 12, "ema12").select(*KEYS, "ema12"))


def family(name: str, sql: dict[str, str], base: dict[str, str] | None = None) -> None:
    """The features of a family as :func:`features.create_features` gives them, with its twin over the same joined inputs."""
    inner = "joined"
    for k, v in (base or {}).items():
        inner = f"(SELECT *, {v} AS {k} FROM {inner})"
    outputs = ", ".join(f"CAST(coalesce(CAST({v} AS FLOAT), 0) AS DOUBLE) AS {k}" for k, v in sql.items())
    query(f"features_{name}", f"SELECT symbol, ts, {outputs} FROM {inner}", " ".join(sql), ctes=f"{BARS},{DERIV},{JOINED}")(lambda s: features.create_features(s.joined(), features.Settings(z_and_delta=name == "z_and_delta")).select(*KEYS, *sql))


FRAMES = {"1h": 1, "4h": 4, "1d": 24}
family("order_flow", {
    **{c: c for c in FLOW}, "d_tbr_base": f"tbr_base - lag(tbr_base) OVER ({P})", "taker_buy_sell_ratio": "taker_buy_base / nullif(volume - taker_buy_base, 0)",
    "z_volume": f"(v - ({full('avg', 'v', 36)})) / nullif({full('stddev_samp', 'v', 36)}, 0)", "rel_close_vwap": "abs(close - quote_asset_volume / nullif(volume, 0)) / nullif(quote_asset_volume / nullif(volume, 0), 0)",
    **{f"{c}_roll_{tf}": full("avg", c, w) for c in FLOW for tf, w in FRAMES.items()}, **{f"{c}_roll_15m": "0" for c in FLOW},
}, FLOW_SQL | {"v": "nullif(volume, 0)"})
family("momentum", {
    "ret3": full("sum", "r", 3), "mom_ret3": full("sum", "r", 3), "volatility_60m": full("stddev_samp", "r", 12), "vol_volatility_60m": full("stddev_samp", "r", 12), "atr14": full("avg", "tr", 14), "vol_atr14": full("avg", "tr", 14),
    **{f"mom_log_ret_{tf}": f"lc - lag(lc, {w}) OVER ({P})" for tf, w in FRAMES.items()}, **{f"vol_realized_{tf}": f"rv{tf}" for tf in FRAMES}, **{f"vol_of_vol_{tf}": full("stddev_samp", f"rv{tf}", w) for tf, w in FRAMES.items()},
    **{f"vol_range_parkinson_{tf}": f"sqrt(({full('avg', 'hl', w)}) / (4 * ln(2)))" for tf, w in FRAMES.items()}, **{f"{c}_15m": "0" for c in ("mom_log_ret", "vol_realized", "vol_of_vol", "vol_range_parkinson")},
}, {"lc": "ln(close)", "r": f"lc - lag(lc) OVER ({P})", "hl": "ln(high / nullif(low, 0)) ** 2", "tr": f"greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P})))"} | {f"rv{tf}": full("stddev_samp", "r", w) for tf, w in FRAMES.items()})
family("derivatives", {
    "basis_annualized": "basis_annualized", "deriv_basis_annualized": "basis_annualized", "oi_delta_15m": f"open_interest - lag(open_interest, 3) OVER ({P})", "deriv_oi_delta_15m": f"open_interest - lag(open_interest, 3) OVER ({P})",
    "deriv_open_interest": "open_interest", "deriv_oi_velocity": f"open_interest - lag(open_interest) OVER ({P})", "deriv_oi_change_pct": f"open_interest / nullif(lag(open_interest) OVER ({P}), 0) - 1", "deriv_funding_rate": "funding_rate",
    "deriv_funding_rate_change": f"funding_rate - lag(funding_rate) OVER ({P})", "deriv_funding_rate_smooth": full("avg", "funding_rate", 4), "deriv_basis_trend": f"basis_annualized - ({full('avg', 'basis_annualized', 4)})",
    "deriv_basis_slope": f"basis_annualized - lag(basis_annualized, 4) OVER ({P})", "deriv_liq_total": "liq_long + liq_short", "deriv_liq_net": "liq_long - liq_short", "deriv_liq_to_oi": "(liq_long + liq_short) / nullif(open_interest, 0)",
})
family("order_book", {
    "lob_imbalance_L1": "(lob_bid_L1 - lob_ask_L1) / nullif(lob_bid_L1 + lob_ask_L1, 0)", "lob_imbalance_L2": "0", "lob_spread_bps": "(a1 - b1) / ((a1 + b1) / 2) * 1e4", "lob_depth_imbalance": "(bs + 2 - ax - 3) / nullif(bs + 2 + ax + 3, 0)",
    "lob_bid_slope_bps": "((b1 * bs + b2 * 2) / (bs + 2) - b1) / b1 * 1e4", "lob_ask_slope_bps": "((a1 * ax + a2 * 3) / (ax + 3) - a1) / a1 * 1e4", "wall_bid_dist_bps": "0", "wall_bid_size_rel": "0", "wall_ask_dist_bps": "0", "wall_ask_size_rel": "0",
}, {"b1": "lob_bid_price_1", "b2": "lob_bid_price_2", "a1": "lob_ask_price_1", "a2": "lob_ask_price_2", "bs": "lob_bid_size_1", "ax": "lob_ask_size_1"})
family("cross_and_time", {
    "cross_ethbtc_ret": "y", "cross_ethbtc_divergence": "x - y", "cross_ethbtc_corr_4h": f"CASE WHEN count(x + y) {rows(4)} = 4 AND max(x) {rows(4)} > min(x) {rows(4)} AND max(y) {rows(4)} > min(y) {rows(4)} THEN corr(x, y) {rows(4)} END",
    **{f"cross_{a}_{m}": "0" for a in features.CROSS_ASSETS if a != "ethbtc" for m in ("ret", "divergence", "corr_4h")},
    **{f"{p}tod_{f}": f"{f}({MINUTE} * (2 * pi() / 1440))" for p in ("", "time_") for f in ("sin", "cos")}, **{f"{p}is_weekend": f"CAST({DAY} >= 5 AS DOUBLE)" for p in ("", "time_")}, "onch_mempool_count": "onch_mempool_count", "onch_height": "0",
}, {"x": f"ln(close) - lag(ln(close)) OVER ({P})", "y": f"ln(ethbtc_close) - lag(ln(ethbtc_close)) OVER ({P})"})
family("z_and_delta", {"z_mom_log_ret_4h": f"(m - ({full('avg', 'm', 36)})) / nullif({full('stddev_samp', 'm', 36)}, 0)", "d_mom_log_ret_4h": f"m - lag(m) OVER ({P})", "d_deriv_open_interest": f"open_interest - lag(open_interest) OVER ({P})"}, {"m": f"ln(close) - lag(ln(close), 4) OVER ({P})"})

# labels
query("lab1_sign", f"SELECT symbol, ts, CASE WHEN ln(lead(close, 2) OVER ({P}) / close) > 0 THEN 1 ELSE 0 END AS cls FROM bars", "", "cls", BARS)(lambda s: s.bars().select(*KEYS, labels.sign_label(2).alias("cls")))
query("lab2_beyond_costs", f"SELECT symbol, ts, CASE WHEN lead(close, 2) OVER ({P}) - close > close * 0.001 THEN 1 ELSE 0 END AS one, CASE WHEN lead(close, 2) OVER ({P}) - close > close * 0.001 THEN 1 WHEN lead(close, 2) OVER ({P}) - close < -close * 0.001 THEN -1 ELSE 0 END AS two FROM bars", "", "one two", BARS)(lambda s: s.bars().select(*KEYS, labels.beyond_costs(2, 10).alias("one"), labels.beyond_costs(2, 10, 2).alias("two")))
BARRIER = f"""{BARS},
n AS (SELECT *, row_number() OVER ({P}) AS i, lead(close, 4) OVER ({P}) AS last FROM bars),
hit AS (SELECT a.symbol, a.ts, arg_min(CASE WHEN b.high >= a.close * 1.005 THEN 1 ELSE -1 END, b.i) AS h FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 4 AND (b.high >= a.close * 1.005 OR b.low <= a.close * 0.995) GROUP BY a.symbol, a.ts),
tb AS (SELECT n.symbol, n.ts, CASE WHEN last IS NULL THEN NULL WHEN h IS NOT NULL THEN h ELSE sign(last - close) END AS decision_240m,
 CASE WHEN last IS NULL THEN NULL WHEN h = 1 THEN 'UP' WHEN h = -1 THEN 'DOWN' ELSE 'NO_TOUCH' END AS touch_240m FROM n LEFT JOIN hit USING (symbol, ts))"""
query("lab3_triple_barrier", "SELECT * FROM tb", "", "decision_240m", BARRIER)(lambda s: labels.triple_barrier(s.bars(), 4, 0.005, 0.005, "240m").select(*KEYS, "decision_240m", "touch_240m"))
FAR = f"""{BARS},
n AS (SELECT symbol, ts, close, high, low, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY symbol) AS c FROM bars),
hit AS (SELECT a.symbol, a.i, min(b.i) AS j FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 300 AND (b.high >= a.close * 1.03 OR b.low <= a.close * 0.97) GROUP BY a.symbol, a.i)"""
query("lab3_far_barrier", "SELECT a.symbol, a.ts, CASE WHEN a.i + 300 > a.c THEN NULL WHEN b.i IS NULL THEN 'NO_TOUCH' WHEN b.high >= a.close * 1.03 THEN 'UP' ELSE 'DOWN' END AS touch_far FROM n a LEFT JOIN hit ON hit.symbol = a.symbol AND hit.i = a.i LEFT JOIN n b ON b.symbol = hit.symbol AND b.i = hit.j", ctes=FAR)(
    lambda s: barriers.far_barrier(s.bars(), 300, 0.03, 0.03, "far").select(*KEYS, "touch_far"))
query("lab5_first_event", "SELECT a.symbol, a.ts, min(b.i - a.i) AS event_step FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 300 AND abs(b.close / a.close - 1) >= 0.03 GROUP BY a.symbol, a.ts", "", "event_step", FAR)(
    lambda s: barriers.first_event(s.bars(), 300, 0.03).select(*KEYS, "event_step"))
query("lab4_touch_summary", "SELECT '240m' AS horizon, avg(CAST(touch_240m <> 'NO_TOUCH' AS INT)) AS p_touch, count(*) FILTER (touch_240m = 'UP') / nullif(count(*) FILTER (touch_240m <> 'NO_TOUCH'), 0)::DOUBLE AS p_up_given_touch FROM tb", "p_touch p_up_given_touch", ctes=BARRIER)(lambda s: labels.touch_summary(labels.triple_barrier(s.bars(), 4, 0.005, 0.005, "240m"), ["240m"]))
HAZ = f"{BARS},\nn AS (SELECT *, row_number() OVER ({P}) AS i FROM bars)"
query("lab5_6_hazard", f"SELECT symbol, ts, CASE WHEN h = 1 THEN 1 ELSE 0 END AS hazard_step_1, CASE WHEN h = 2 THEN 1 ELSE 0 END AS hazard_step_2, CASE WHEN h = 3 THEN 1 ELSE 0 END AS hazard_step_3, h AS time_to_event FROM (SELECT a.symbol, a.ts, min(b.i - a.i) AS h FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 3 AND abs(b.close / a.close - 1) >= 0.002 GROUP BY a.symbol, a.ts)", "hazard_step_1 hazard_step_2 hazard_step_3", "time_to_event", HAZ)(lambda s: labels.hazard(s.bars(), 3, 0.002).withColumn("time_to_event", labels.time_to_event(3)).select(*KEYS, "hazard_step_1", "hazard_step_2", "hazard_step_3", "time_to_event"))
query("lab7_fil2_targets", f"SELECT symbol, ts, CASE WHEN l > close THEN 1 ELSE 0 END AS target_cls FROM (SELECT *, lead(close, 4) OVER ({P}) AS l FROM bars) WHERE l IS NOT NULL", "", "target_cls", BARS)(lambda s: labels.targets(s.bars(), 4).select(*KEYS, "target_cls"))
query("lab8_regression_target", f"SELECT symbol, ts, l AS target_reg, CASE WHEN l > close THEN 1 ELSE 0 END AS target_cls FROM (SELECT *, lead(close, 4) OVER ({P}) AS l FROM bars) WHERE l IS NOT NULL", "target_reg", "target_cls", BARS)(lambda s: labels.regression_target(s.bars(), 4).select(*KEYS, "target_reg", "target_cls"))


# signals
def ruled(s: Inputs) -> DataFrame:
    b = s.bars().withColumns({"rsi": windows.rsi(X.C), "s7": windows.sma(X.C, 7), "s14": windows.sma(X.C, 14), "p": F.col("number_of_trades") % 10 / 10})
    return b.withColumns({"rule_rsi": signals.below(F.col("rsi"), 45.0), "rule_sma": signals.crossover(F.col("s7"), F.col("s14"))})


RULES = f"""{BARS},
chg AS (SELECT *, coalesce(close - lag(close) OVER ({P}), 0) AS ch, (number_of_trades % 10) / 10.0::DOUBLE AS p FROM bars),
ind AS (SELECT *, CASE WHEN {DOWN} > 0 THEN 100 - 100 / (1 + ({UP}) / ({DOWN})) WHEN {UP} > 0 THEN 100 END AS rsi, {full('avg', 'close', 7)} AS s7, {full('avg', 'close', 14)} AS s14 FROM chg),
rules AS (SELECT *, CASE WHEN rsi < 45 THEN 1 ELSE 0 END AS rule_rsi, CASE WHEN s7 > s14 + 1e-9 THEN 1 ELSE 0 END AS rule_sma FROM ind)"""
query("rul1_2_rules", "SELECT symbol, ts, rule_rsi, rule_sma FROM rules", "", "rule_rsi rule_sma", RULES)(lambda s: ruled(s).select(*KEYS, "rule_rsi", "rule_sma"))
query("rul3_blend", "SELECT symbol, ts, CASE WHEN (rule_rsi * 2 + rule_sma) / 3.0 >= 0.5 THEN 1 ELSE 0 END AS signal FROM rules", "", "signal", RULES)(lambda s: ruled(s).select(*KEYS, signals.blended(F.col("rule_rsi"), F.col("rule_sma"), 2.0, 1.0).alias("signal")))
query("rul4_with_model", f"""SELECT symbol, ts, greatest(rule_sma, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS majority, least(rule_sma, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS strict,
 coalesce(last_value(CASE WHEN rule_sma * 0.5 + p * 0.5 >= 0.5 THEN 1 WHEN rule_sma * 0.5 + p * 0.5 <= 0.3 THEN 0 END IGNORE NULLS) OVER ({P}), 0) AS weighted FROM rules""", "", "majority strict weighted", RULES)(lambda s: ruled(s).select(*KEYS, *[signals.with_model(F.col("rule_sma"), F.col("p"), h, 0.5, 0.5, 0.2).alias(h) for h in ("majority", "strict", "weighted")]))


def flagship(s: Inputs) -> DataFrame:
    """Hourly bars, momentum, realised volatility, average true range and the first-touch label of the next four bars."""
    b = features.momentum(s.bars(), 60).select("symbol", "interval", *("ts open high low close".split()), "mom_log_ret_4h", "vol_realized_1d", "atr14")
    return labels.triple_barrier(b, 4, 0.005, 0.005, "240m").select(*KEYS, "mom_log_ret_4h", "vol_realized_1d", "atr14", "decision_240m", "touch_240m")


query("flagship_features_and_labels", f"""SELECT symbol, ts, lc - lag(lc, 4) OVER ({P}) AS mom_log_ret_4h, {full('stddev_samp', 'r', 24)} AS vol_realized_1d, {full('avg', 'tr', 14)} AS atr14, decision_240m, touch_240m FROM (
  SELECT symbol, ts, lc, lc - lag(lc) OVER ({P}) AS r, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS tr FROM (SELECT *, ln(close) AS lc FROM bars)) JOIN tb USING (symbol, ts)""", "mom_log_ret_4h vol_realized_1d atr14", "decision_240m", BARRIER)(flagship)
