"""Row-local column functions. Nulls stand for missing values everywhere; NaN never enters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Minutes of the interval labels.
INTERVALS = {"1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720, "1d": 1440}

#: Feature groups, in order: the first pattern that is found in a name wins (fixed values).
GROUP_PATTERNS = [
    ("orderflow", r"^tbr_|^ofi_|^cvd_|^taker_|rel_close_vwap|z_volume"),
    ("derivatives", r"^oi_|^basis_|^funding_|^deriv_"),
    ("lob", r"^lob_|^queue_|book_slope|^wall_"),
    ("momentum_vol", r"ret|^volatility_|^atr_|skew|kurt"),
    ("time", r"^tod_|^session_|funding_cycle|^dow_|^time_"),
    ("onchain", r"^onch_"),
    ("cross_asset", r"^cross_"),
    ("price_ref", r"^open$|^high$|^low$|^close$|^mid$"),
]


def not_nan(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: applied at each source."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def safe_double(c: Column) -> Column:
    """A trimmed string or a number as a double; blank, NaN and garbage are null."""
    x = F.expr("try_cast(null as double)") if c is None else F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def utc_timestamp(c: Column) -> Column:
    """ISO text, text with a zone, or epoch seconds as text or number, as a UTC timestamp; null if it is none of these."""
    s = F.trim(c.cast("string"))
    return F.coalesce(F.when(s.rlike(r"^\d{4}-"), F.try_to_timestamp(s)), F.timestamp_seconds(F.when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), s.try_cast("double"))))


def minutes_of(label: Column) -> Column:
    """Minutes of an interval label, null for an unknown one."""
    return F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in INTERVALS.items()])


def interval_minutes(label: str) -> int:
    if label not in INTERVALS:
        raise ValueError(f"unknown interval {label!r}")
    return INTERVALS[label]


def steps_for(minutes: int, base: int) -> int:
    """How many candles of ``base`` minutes make ``minutes``; an error if they do not divide."""
    if minutes <= 0 or base <= 0 or minutes % base:
        raise ValueError(f"{minutes} minutes are no multiple of {base}")
    return minutes // base


def minutes_label(m: Column) -> Column:
    """``15m``, ``4h``, ``1d``."""
    whole = lambda n, unit: F.concat((m / n).cast("long").cast("string"), F.lit(unit))
    return F.when(m % 1440 == 0, whole(1440, "d")).when(m % 60 == 0, whole(60, "h")).otherwise(whole(1, "m"))


def feature_group(name: Column, patterns: Sequence[tuple[str, str]] = GROUP_PATTERNS) -> Column:
    out = None
    for group, pattern in patterns:
        out = F.when(name.rlike(pattern), group) if out is None else out.when(name.rlike(pattern), group)
    return out.otherwise("other")


def time_features(ts: Column) -> dict[str, Column]:
    """Cyclic minute of day, hour and day of week (Monday is 0), and day, night and weekend flags."""
    hour, minute, day = F.hour(ts), F.hour(ts) * 60 + F.minute(ts), F.weekday(ts)
    out = {}
    for name, value, n in (("tod", minute, 1440), ("time_hour", hour, 24), ("time_dow", day, 7)):
        angle = value * F.lit(2 * math.pi / n)
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    is_day, weekend = (hour >= 8) & (hour < 20), day >= 5
    return out | {"is_day": is_day.cast("double"), "is_night": (~is_day).cast("double"), "is_weekend": weekend.cast("double"), "is_weekday": (~weekend).cast("double")}


def taker_flow(taker: Column, volume: Column) -> tuple[Column, Column]:
    """Taker-buy ratio and order-flow imbalance ``2r - 1``."""
    r = ratio(taker, volume)
    return r, 2 * r - 1


def vwap_distance(close: Column, quote: Column, volume: Column) -> Column:
    vwap = ratio(quote, volume)
    return ratio(F.abs(close - vwap), vwap)


def taker_buy_sell(taker: Column, volume: Column) -> Column:
    return ratio(taker, volume - taker)


def liquidation(long: Column, short: Column, interest: Column) -> dict[str, Column]:
    return {"deriv_liq_total": long + short, "deriv_liq_net": long - short, "deriv_liq_to_oi": ratio(long + short, interest)}


def imbalance(bid: Column, ask: Column) -> Column:
    return ratio(bid - ask, bid + ask)


def spread_bps(bid: Column, ask: Column) -> Column:
    return ratio(ask - bid, (ask + bid) / 2) * 1e4
