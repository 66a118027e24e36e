"""The feature families of a candle frame, in three window stages over one shuffle and one sort."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions import scalars as S
from ..functions.rolling import KEY, correlation, delta, deviation, filled, mean, series, total, z_score
from ..sources.shared import written
from .parts import numbered, running
from .timegrid import halo_blocks, rows_for
from .windows import ema, emas, hour_fill

#: Required columns, and the other names and constants below: fixed values of the feature contract.
REQUIRED = ("timestamp", "open", "high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base", "taker_buy_quote")
TIMEFRAMES = {15: "15m", 60: "1h", 240: "4h", 1440: "1d"}
CROSS_ASSETS = {
    "ethbtc": ("ethbtc",),
    "btcd": ("btc.d", "btc_dom", "btcdominance", "btc_d"),
    "dxy": ("dxy",),
    "es": ("es1", "es_", "sp500", "spx"),
    "nq": ("nq1", "nasdaq", "nq_"),
    "gold": ("xau", "gold"),
}
FUNDING = ("deriv_funding_rate", "funding_rate", "funding_8h", "perp_funding_rate")
LIQ_LONG = ("deriv_liq_long", "liquidations_long", "liquidations_buy", "liq_long")
LIQ_SHORT = ("deriv_liq_short", "liquidations_short", "liquidations_sell", "liq_short")
ONCHAIN = (
    "onch_fee_fast_satvb", "onch_fee_30m_satvb", "onch_fee_60m_satvb", "onch_fee_min_satvb", "onch_mempool_count", "onch_mempool_vsize_vB",
    "onch_mempool_total_fee_sat", "onch_fee_wavg_satvb", "onch_fee_p50_satvb", "onch_fee_p90_satvb", "onch_difficulty", "onch_height", "onch_diff_change_pct",
)
#: The features that a model may ask for, by family (fixed values).
BASE = (
    "ofi_base", "ofi_quote", "tbr_base", "d_tbr_base", "ema12_tbr_base", "taker_buy_sell_ratio", "z_volume", "rel_close_vwap", "ret3",
    "ofi_base_roll_15m", "ofi_base_roll_1h", "ofi_quote_roll_15m", "ofi_quote_roll_1h", "tbr_base_roll_15m", "tbr_base_roll_1h",
    "mom_log_ret_15m", "mom_log_ret_1h", "mom_log_ret_4h", "mom_log_ret_1d", "volatility_60m", "atr14",
    "vol_realized_15m", "vol_realized_1h", "vol_realized_4h", "vol_realized_1d", "vol_of_vol_15m", "vol_of_vol_1h", "vol_of_vol_4h", "vol_of_vol_1d",
    "vol_range_parkinson_15m", "vol_range_parkinson_1h", "vol_range_parkinson_4h", "vol_range_parkinson_1d", "mom_microtrend_ema_ratio",
    "tod_sin", "tod_cos", "is_day", "is_night", "is_weekend", "is_weekday", "time_hour_sin", "time_hour_cos", "time_dow_sin", "time_dow_cos",
    *[f"cross_{asset}_{measure}" for asset in CROSS_ASSETS for measure in ("ret", "divergence", "corr_4h")],
)
ORDERBOOK = ("lob_imbalance_L1", "lob_imbalance_L2", "wall_bid_dist_bps", "wall_bid_size_rel", "wall_ask_dist_bps", "wall_ask_size_rel", "lob_spread_bps", "lob_depth_imbalance", "lob_bid_slope_bps", "lob_ask_slope_bps")
DERIVATIVES = (
    "oi_delta_15m", "basis_annualized", "deriv_funding_rate", "deriv_funding_rate_change", "deriv_funding_rate_smooth", "deriv_basis_trend", "deriv_basis_slope",
    "deriv_open_interest", "deriv_oi_change_pct", "deriv_oi_velocity", "deriv_liq_total", "deriv_liq_net", "deriv_liq_to_oi",
)
#: Copies under prefixed names (fixed values).
ALIASES = {
    "basis_annualized": "deriv_basis_annualized", "oi_delta_15m": "deriv_oi_delta_15m", "lob_imbalance_L1": "lob_imbalance_L1", "lob_imbalance_L2": "lob_imbalance_L2",
    "ret3": "mom_ret3", "volatility_60m": "vol_volatility_60m", "atr14": "vol_atr14", "tod_sin": "time_tod_sin", "tod_cos": "time_tod_cos",
    "is_day": "time_is_day", "is_night": "time_is_night", "is_weekend": "time_is_weekend", "is_weekday": "time_is_weekday",
}
Z_ROWS = 36


@dataclass(frozen=True)
class Settings:
    step_minutes: int = 60
    orderbook: bool = True
    derivatives: bool = True
    onchain: bool = True
    forward_fill_limit: int = 12
    fill: float = 0.0
    z_and_delta: bool = True


def registered(settings: Settings = Settings()) -> list[str]:
    """The names of the features under ``settings``; :func:`create_features` gives each of them, whatever inputs are there."""
    return [*BASE, *ORDERBOOK * settings.orderbook, *DERIVATIVES * settings.derivatives, *ONCHAIN * settings.onchain]


def check_inputs(df: DataFrame, settings: Settings = Settings(), required: Sequence[str] = REQUIRED) -> None:
    """Errors for missing columns (by sorted name) and, where the family is on, unknown on-chain ones."""
    names = {"timestamp" if c == "ts" else c for c in df.columns}
    if missing := sorted(set(required) - names):
        raise KeyError(f"missing columns: {missing}")
    if settings.onchain and (unknown := sorted(c for c in names if c.startswith("onch_") and c not in ONCHAIN)):
        raise ValueError(f"unknown on-chain columns: {unknown}")


def unparsable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each text column, how many values are no numbers."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in columns])


def ensure_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as doubles; a TypeError names those that do not parse. One aggregation for all of them."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if texts and (bad := sorted(c for c, n in unparsable(df, texts).first().asDict().items() if n)):
        raise TypeError(f"not numeric: {bad}")
    return df.withColumns({c: F.col(c).cast("double") for c in texts})


def match_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first column that holds the first candidate, else the next candidate; case does not matter."""
    return next((c for k in candidates for c in columns if k in c.lower()), None)


def constants(names: Sequence[str], fill: float) -> dict[str, Column]:
    return {n: F.lit(float(fill)) for n in names}


def rows_or(minutes: int, step: int, other: int) -> int:
    """The rows of a span, or ``other`` where the candles are longer than it."""
    return rows_for(minutes, step) if minutes >= step else other


def momentum(df: DataFrame, step: int, fill: float = 0.0) -> DataFrame:
    """Returns, volatilities, ranges and the trend ratio; those of timeframes shorter than a candle are ``fill``."""
    by = series()
    lc = F.ln("close")
    df = df.withColumns({"_r": lc - F.lag(lc).over(by), "_hl": F.pow(F.ln(F.try_divide("high", F.col("low"))), 2)})
    first = {"ret3": total(F.col("_r"), 3, by), "volatility_60m": deviation(F.col("_r"), 12, by)}
    c1 = F.lag("close").over(by)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c1), F.abs(F.col("low") - c1))
    for m, tf in TIMEFRAMES.items():
        if m < step:
            first |= constants([f"{c}_{tf}" for c in ("mom_log_ret", "vol_realized", "vol_range_parkinson")], fill)
            continue
        w = rows_for(m, step)
        first[f"mom_log_ret_{tf}"] = lc - F.lag(lc, w).over(by)
        first[f"vol_realized_{tf}"] = deviation(F.col("_r"), w, by)
        first[f"vol_range_parkinson_{tf}"] = F.sqrt(mean(F.col("_hl"), w, by) / (4 * math.log(2)))
    df = df.withColumns(first | {"_tr": tr})
    second = {"atr14": mean(F.col("_tr"), 14, by)}
    for m, tf in TIMEFRAMES.items():
        second[f"vol_of_vol_{tf}"] = deviation(F.col(f"vol_realized_{tf}"), rows_for(m, step), by) if m >= step else F.lit(float(fill))
    df = df.withColumns(second).drop("_r", "_hl", "_tr")
    df = df if "_fast" in df.columns else emas(df, trend_spans(step))
    return df.withColumn("mom_microtrend_ema_ratio", F.try_divide(F.col("_fast") - F.col("_slow"), F.col("close"))).drop("_fast", "_slow")


def trend_spans(step: int) -> dict[str, tuple[str, int]]:
    fast = max(2, rows_or(60, step, 12))
    return {"_fast": ("close", fast), "_slow": ("close", max(fast + 1, rows_or(240, step, 4 * fast)))}


def order_flow(df: DataFrame, step: int, fill: float = 0.0) -> DataFrame:
    by = series()
    tbr, ofi = S.taker_flow(F.col("taker_buy_base"), F.col("volume"))
    _, ofq = S.taker_flow(F.col("taker_buy_quote"), F.col("quote_asset_volume"))
    volume = F.when(F.col("volume") != 0, F.col("volume"))
    df = df.withColumns({
        "tbr_base": tbr, "ofi_base": ofi, "ofi_quote": ofq, "_v": volume, "rel_close_vwap": S.vwap_distance(F.col("close"), F.col("quote_asset_volume"), F.col("volume")),
        "taker_buy_sell_ratio": S.taker_buy_sell(F.col("taker_buy_base"), F.col("volume")),
    })
    out = {"d_tbr_base": delta(F.col("tbr_base"), by), "z_volume": z_score(F.col("_v"), Z_ROWS, by)}
    for m, tf in TIMEFRAMES.items():
        for c in ("ofi_base", "ofi_quote", "tbr_base"):
            out[f"{c}_roll_{tf}"] = mean(F.col(c), rows_for(m, step), by) if m >= step else F.lit(float(fill))
    df = df if "ema12_tbr_base" in df.columns else ema(df, "tbr_base", 12, "ema12_tbr_base")
    return df.withColumns(out).drop("_v")


def derivatives(df: DataFrame, step: int, fill: float = 0.0) -> DataFrame:
    """Open interest, funding, basis and liquidation columns from those of the input that are there; what rests on an absent one is ``fill``."""
    by, names = series(), df.columns
    h, d = rows_or(60, step, 3), rows_or(240, step, 12)
    number = lambda c: F.col(c).cast("double") if c else F.lit(float(fill))
    interest = "open_interest" in names
    oi = F.col("open_interest").cast("double") if interest else F.lit(None).cast("double")
    basis = number("basis_annualized" if "basis_annualized" in names else None)
    df = df.withColumns({"_oi": oi, "deriv_funding_rate": number(match_column(names, FUNDING)), "basis_annualized": basis, "_pad": F.col("_pad") if "_pad" in names else filled(oi, by)})
    b, f = F.col("basis_annualized"), F.col("deriv_funding_rate")
    of_interest = {
        "oi_delta_15m": delta(F.col("_oi"), by, 3), "deriv_open_interest": F.col("_oi"), "deriv_oi_velocity": delta(F.col("_oi"), by, h),
        "deriv_oi_change_pct": F.try_divide(F.col("_pad"), F.lag("_pad").over(by)) - 1,
    }
    long, short = match_column(names, LIQ_LONG), match_column(names, LIQ_SHORT)
    forced = S.liquidation(number(long), number(short), F.col("_oi"))
    if not long and not short:
        forced = constants(list(forced), fill)
    elif not interest:
        forced |= constants(["deriv_liq_to_oi"], fill)
    return df.withColumns({
        **(of_interest if interest else constants(list(of_interest), fill)), **forced,
        "deriv_funding_rate_change": delta(f, by), "deriv_funding_rate_smooth": mean(f, d, by), "deriv_basis_trend": b - mean(b, d, by), "deriv_basis_slope": delta(b, by, d),
    }).drop("_oi", "_pad")


def cross_assets(df: DataFrame, columns: Mapping[str, str], step: int, every: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """For each asset's price column: its log return, the own return less it, and their rolling correlation over four hours; for those of
    ``every`` that have none, ``fill``."""
    by, w = series(), rows_or(240, step, rows_or(60, step, 1))
    ret = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by)
    df = df.withColumns({"_own": ret(F.col("close"))} | {f"cross_{a}_ret": ret(F.col(c)) for a, c in columns.items()})
    out = {f"cross_{a}_divergence": F.col("_own") - F.col(f"cross_{a}_ret") for a in columns}
    out |= {f"cross_{a}_corr_4h": correlation(F.col("_own"), F.col(f"cross_{a}_ret"), w, by) if w > 1 else F.lit(float(fill)) for a in columns}
    out |= constants([f"cross_{a}_{m}" for a in every if a not in columns for m in ("ret", "divergence", "corr_4h")], fill)
    return df.withColumns(out).drop("_own")


def order_book(df: DataFrame, fill: float = 0.0) -> DataFrame:
    """Imbalances, spread, walls and slopes from ``lob_{side}_L{n}`` and the levels of both sides; what rests on absent columns is ``fill``."""
    have = {side: any(c.startswith(f"lob_{side}_price_") for c in df.columns) and any(c.startswith(f"lob_{side}_size_") for c in df.columns) for side in ("bid", "ask")}
    df = df.withColumns({f"_{side}s": arrays.levels_of(df, side) for side, there in have.items() if there})
    df = df.withColumns({f"_wall_{side}": arrays.wall(F.col(f"_{side}s"), F.col("close"), side) for side, there in have.items() if there})
    out = constants(ORDERBOOK, fill)
    for n in (1, 2):
        if f"lob_bid_L{n}" in df.columns and f"lob_ask_L{n}" in df.columns:
            out[f"lob_imbalance_L{n}"] = S.imbalance(F.col(f"lob_bid_L{n}"), F.col(f"lob_ask_L{n}"))
        elif f"lob_imbalance_L{n}" in df.columns:
            del out[f"lob_imbalance_L{n}"]
    for side, there in have.items():
        if there:
            out |= {f"wall_{side}_{x}": F.col(f"_wall_{side}")[x] for x in ("dist_bps", "size_rel")} | {f"lob_{side}_slope_bps": arrays.slope_bps(F.col(f"_{side}s"))}
    if all(have.values()):
        best = lambda side: F.get(F.col(f"_{side}s"), F.lit(0))["price"]
        out |= {"lob_spread_bps": S.spread_bps(best("bid"), best("ask")), "lob_depth_imbalance": arrays.depth_imbalance(F.col("_bids"), F.col("_asks"))}
    return df.withColumns(out).drop("_bids", "_asks", "_wall_bid", "_wall_ask")


def z_and_delta(df: DataFrame, columns: Sequence[str], rows: int = Z_ROWS) -> DataFrame:
    """``z_*`` and ``d_*`` of each column, in one window stage."""
    by = series()
    new = {f"z_{c}": z_score(F.col(c), rows, by) for c in columns} | {f"d_{c}": delta(F.col(c), by) for c in columns}
    return df.withColumns({n: c for n, c in new.items() if n not in df.columns})


def aliases(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Copies under prefixed names, none that is there is overwritten."""
    return df.withColumns({new: F.col(old) for old, new in pairs.items() if old in df.columns and new not in df.columns})


def active(columns: Sequence[str], settings: Settings) -> list[str]:
    """The columns without those of families that are off."""
    off = ("lob_", "wall_", "z_lob_", "d_lob_") * (not settings.orderbook) + ("deriv_", "oi_", "basis_", "z_deriv_", "d_deriv_") * (not settings.derivatives) + ("onch_", "z_onch_", "d_onch_") * (not settings.onchain)
    return [c for c in columns if not c.startswith(off)] if off else list(columns)


def finished(df: DataFrame, keep: Sequence[str], fill: float = 0.0) -> DataFrame:
    """All but ``keep`` as floats, nulls filled: the last step, so that everything before sees nulls. A TypeError names columns that hold no numbers."""
    numbers = T.NumericType | T.BooleanType
    if bad := sorted(f.name for f in df.schema if f.name not in keep and not isinstance(f.dataType, numbers)):
        raise TypeError(f"no numbers: {bad}")
    return df.select(*keep, *[F.coalesce(F.col(c).cast("float"), F.lit(fill).cast("float")).alias(c) for c in df.columns if c not in keep])


def holes(df: DataFrame, keep: Sequence[str] = (*KEY, "ts")) -> DataFrame:
    """One row: for each column but ``keep``, how many values are null or NaN."""
    return df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in df.columns if c not in keep])


def assert_finished(df: DataFrame, keep: Sequence[str] = (*KEY, "ts")) -> None:
    """A ValueError names the columns with a null or NaN; one aggregation."""
    if bad := sorted(c for c, n in holes(df, keep).first().asDict().items() if n):
        raise ValueError(f"values missing in {bad}")


def create_features(df: DataFrame, settings: Settings = Settings(), block_rows: int | None = None) -> DataFrame:
    """All families of a candle frame keyed by ``symbol, interval, ts``; every name of :func:`registered` is there.

    A series is one task's work by default. With ``block_rows`` it is cut into blocks of so many rows, each a task's with the rows before it that
    its frames need: what has no finite frame (averages, the last known open interest) is carried over the blocks beforehand. The
    result is the same; it takes a few more exchanges, so it is for series of many times ``block_rows`` rows.
    """
    check_inputs(df, settings)
    step, given, fill = settings.step_minutes, df.columns, settings.fill
    if settings.onchain:
        df = df.withColumns({c: F.coalesce(hour_fill(F.col(c), settings.forward_fill_limit), F.lit(float(fill))) if c in given else F.lit(float(fill)) for c in ONCHAIN})
    if block_rows:
        df = written(numbered(df, list(KEY), ["ts"], "_n"), "numbered")
        if settings.derivatives and "open_interest" in given:
            df = running(df, list(KEY), ["ts"], _pad=("last", F.col("open_interest").cast("double")))
    # all averages with memory in one pass, before the windows, so that these need one exchange
    tbr, _ = S.taker_flow(F.col("taker_buy_base"), F.col("volume"))
    df = emas(df.withColumn("_tbr", tbr), trend_spans(step) | {"ema12_tbr_base": ("_tbr", 12)}, long=bool(block_rows)).drop("_tbr", "_part")
    if not block_rows:
        return finished(families(df, settings, given), [*KEY, "ts"], fill)
    cut = halo_blocks(df, block_rows, halo_of(step)).withColumns({"_symbol": F.col("symbol"), "symbol": F.concat_ws("\x01", "symbol", "_block")}).drop("_block")
    out = finished(families(cut, settings, given), [*KEY, "ts", "_symbol", "_halo"], fill).where("not _halo")
    return out.withColumn("symbol", F.col("_symbol")).drop("_symbol", "_halo")


def halo_of(step: int) -> int:
    """Rows before a block that all frames together reach back to: a deviation of deviations over a day, its score, and lags."""
    return 2 * max(rows_or(1440, step, 50), 50) + Z_ROWS + 16


def families(df: DataFrame, settings: Settings, given: Sequence[str]) -> DataFrame:
    """The features of ``df``, which has the averages already; ``given``: the columns of the input."""
    step, fill = settings.step_minutes, settings.fill
    out = order_flow(momentum(df, step, fill), step, fill).withColumns(S.time_features(F.col("ts")))
    if settings.derivatives:
        out = derivatives(out, step, fill)
    if settings.orderbook:
        out = order_book(out, fill)
    found = {a: c for a, k in CROSS_ASSETS.items() if (c := match_column(given, k))}
    out = cross_assets(out, found, step, list(CROSS_ASSETS), fill)
    out = aliases(out.select(*active(out.columns, settings)), ALIASES)
    if settings.z_and_delta:
        prefixes = ("mom_", "vol_", "time_", "cross_") + ("onch_",) * settings.onchain + ("deriv_",) * settings.derivatives + ("lob_",) * settings.orderbook
        out = z_and_delta(out, [c for c in out.columns if c.startswith(prefixes)])
    return out


def match_contract(df: DataFrame, contract: Sequence[str], fill: float = 0.0, dtype: str = "float", keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the features of a model, once each, in its order: missing ones filled, others dropped, all cast."""
    columns = [F.coalesce(F.col(c).cast(dtype), F.lit(fill).cast(dtype)).alias(c) if c in df.columns else F.lit(fill).cast(dtype).alias(c) for c in dict.fromkeys(contract)]
    return df.select(*keep, *columns)


def feature_columns(df: DataFrame, base: Sequence[str], label_prefixes: Sequence[str]) -> list[str]:
    """Names of the features: neither base columns nor labels."""
    return [c for c in df.columns if c not in base and not c.startswith(tuple(label_prefixes))]


def backtest_columns(df: DataFrame, timestamp: str = "timestamp", prediction: str = "p_hat", target: str = "target", price: str = "last_price") -> DataFrame:
    """The four columns of a backtest under their own names (times parsed, unparsable ones null), without the rows that lack one of them; other columns stay."""
    if missing := sorted({timestamp, prediction, target, price} - set(df.columns)):
        raise KeyError(f"missing columns: {missing}")
    out = df.withColumnsRenamed({timestamp: "timestamp", prediction: "p_hat", target: "target", price: "last_price"})
    if isinstance(out.schema["timestamp"].dataType, T.StringType):
        out = out.withColumn("timestamp", S.utc_timestamp(F.col("timestamp")))
    return out.na.drop(subset=["timestamp", "p_hat", "target", "last_price"])
