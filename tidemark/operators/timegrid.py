"""Bars, grids, resampling, alignment, deduplication and merging of series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import KEY, series
from .parts import numbered


def floor_to(ts: Column, seconds: int) -> Column:
    t = F.unix_micros(ts)
    return F.timestamp_micros(t - F.pmod(t, F.lit(seconds * 1_000_000)))


def ceil_to(ts: Column, seconds: int) -> Column:
    """The right end of the bucket ``(t - d, t]`` that holds ``ts``, to the microsecond."""
    t, d = F.unix_micros(ts), F.lit(seconds * 1_000_000)
    return F.timestamp_micros(t + F.pmod(-t, d))


def bars(ticks: DataFrame, seconds: int, symbol: Column, price: Column, size: Column, taker: Column, tie: str = "event_id", label: str = "1h") -> DataFrame:
    """Candles from ticks (``ts`` and the given columns): first, max, min, last and sums per bucket, in one aggregation."""
    t = ticks.select(symbol.alias("symbol"), floor_to(F.col("ts"), seconds).alias("bar"), F.struct("ts", tie).alias("at"), price.alias("px"), size.cast("double").alias("qty"), taker.alias("taker"))
    side = lambda x: F.sum(F.when(F.col("taker"), x).otherwise(0.0))
    out = t.groupBy("symbol", "bar").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("px") * F.col("qty")).alias("quote_asset_volume"), F.count("*").alias("number_of_trades"),
        side(F.col("qty")).alias("taker_buy_base"), side(F.col("px") * F.col("qty")).alias("taker_buy_quote"),
    )
    return out.select("symbol", F.lit(label).alias("interval"), F.col("bar").alias("ts"), *out.columns[2:])


def step_minutes(df: DataFrame, how: str = "round") -> DataFrame:
    """``symbol, interval, step_minutes``: the median distance of neighbours; rounded, at least 1 (``how`` round) or floored."""
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(series())) / 60e6
    m = df.withColumn("gap", gap).where("gap is not null").groupBy("symbol", "interval").agg(F.median("gap").alias("m"))
    whole = F.floor("m") if how == "floor" else F.bround("m", 0)
    return m.select("symbol", "interval", F.greatest(whole.cast("long"), F.lit(1)).alias("step_minutes"))


def rows_for(minutes: int, step: int) -> int:
    """How many rows a span of ``minutes`` is, at least one."""
    return max(1, round(minutes / step))


def grid(spans: DataFrame, seconds: int) -> DataFrame:
    """The keys of ``spans`` with each grid time ``ts`` from the floor of ``start`` to the ceiling of ``end``, both included."""
    keys = [c for c in spans.columns if c not in ("start", "end")]
    points = F.sequence(floor_to(F.col("start"), seconds), ceil_to(F.col("end"), seconds), F.expr(f"interval {seconds} seconds"))
    return spans.select(*keys, F.explode(points).alias("ts"))


def resample(df: DataFrame, seconds: int, aggs: dict[str, Column], keys: Sequence[str] = ("symbol",), empty: dict[str, object] | None = None) -> DataFrame:
    """Right-closed, right-labelled buckets; those without rows between a key's first and last are emitted with ``empty`` values."""
    got = df.groupBy(*keys, ceil_to(F.col("ts"), seconds).alias("ts")).agg(*[c.alias(n) for n, c in aggs.items()])
    spans = got.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    out = grid(spans, seconds).join(got.withColumn("_hit", F.lit(True)), [*keys, "ts"], "left")
    fill = {n: F.when(F.col("_hit").isNull(), F.lit(v)).otherwise(F.col(n)) for n, v in (empty or {}).items()}
    return out.withColumns(fill).drop("_hit")


def keep_last(df: DataFrame, keys: Sequence[str], arrival: str | Column) -> DataFrame:
    """The last arrival for each key; rows with a null key go."""
    order = F.col(arrival) if isinstance(arrival, str) else arrival
    by = Window.partitionBy(*keys).orderBy(order.desc())
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(whole).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def align(points: DataFrame, times: DataFrame, keys: Sequence[str] = ("ts",), arrival: str = "arrival") -> DataFrame:
    """One row for each grid time: the last point exactly there; points off the grid go."""
    return times.join(keep_last(points, keys, arrival).drop(arrival), list(keys), "left")


def merge_sources(times: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """All sources on the grid; where several have a column, the last non-null one in order of ``sources`` holds."""
    out, columns = times, {}
    for i, s in enumerate(sources):
        names = {c: f"_{i}_{c}" for c in s.columns if c not in keys}
        out = out.join(s.withColumnsRenamed(names), list(keys), "left")
        for c, n in names.items():
            columns.setdefault(c, []).insert(0, n)
    return out.select(*times.columns, *[F.coalesce(*ns).alias(c) for c, ns in columns.items()])


def outer_on_time(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("ts",), suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join on time; columns of both sides take the suffixes."""
    both = {c for c in left.columns if c in right.columns} - set(keys)
    a, b = (d.withColumnsRenamed({c: c + s for c in both}) for d, s in zip((left, right), suffixes, strict=True))
    return a.join(b, list(keys), "full_outer")


def as_of_hour(candles: DataFrame, snapshots: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last known snapshot at or before each candle within the same clock hour, by one window over the union."""
    empty = candles.select(*keys, "ts", F.lit(1).alias("_side"), F.struct(*candles.columns).alias("_row"))
    some = snapshots.select(*keys, "ts", F.lit(0).alias("_side"), *columns)
    both = empty.unionByName(some, allowMissingColumns=True)
    by = Window.partitionBy(*keys, F.date_trunc("hour", "ts")).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in columns})
    return both.where("_side = 1").select("_row.*", *columns)


def actuals(predictions: DataFrame, prices: DataFrame, arrival: str = "close") -> DataFrame:
    """Fills ``y_true_hat`` and ``abs_error`` of pending predictions from the price at their target time; others are untouched.

    Prices are first cut to the times that are needed (a semi-join); of several for one time the last by ``arrival`` holds (by default
    the highest). Those without a price stay pending.
    """
    pending = F.col("y_true_hat").isNull() & F.col("target_time_ms").isNotNull()
    at = predictions.where(pending).select("symbol", F.col("target_time_ms").alias("open_time"))
    price = prices.join(at, ["symbol", "open_time"], "left_semi").groupBy("symbol", "open_time").agg(F.max_by("close", arrival).alias("close"))
    p = predictions.join(price.withColumnRenamed("open_time", "target_time_ms"), ["symbol", "target_time_ms"], "left")
    y = F.when(pending, F.col("close")).otherwise(F.col("y_true_hat"))
    e = F.when(pending & F.col("close").isNotNull(), F.abs(F.col("p_hat") - F.col("close"))).otherwise(F.col("abs_error"))
    return p.withColumns({"y_true_hat": y, "abs_error": e}).select(*predictions.columns)


def trim_tail(df: DataFrame, h: int, label: str | None = None) -> DataFrame:
    """Without the last ``h`` rows of each series and without rows whose ``label`` is null."""
    out = df.withColumn("_later", F.lead("ts", h).over(series())).where("_later is not null").drop("_later")
    return out.where(F.col(label).isNotNull()) if label else out


def halo_blocks(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """Cuts each series into blocks of ``rows``, each with the ``halo`` rows before it (``_halo`` true), so that finite frames
    can be computed by (symbol, interval, ``_block``) on many tasks even for one long series. Rows are numbered by parts of the series, unless
    their number (``_n``, from 1) is there."""
    t = df if "_n" in df.columns else numbered(df, list(KEY), ["ts"], "_n").drop("_part")
    n = F.col("_n") - 1
    own = F.floor(n / rows)
    last = F.floor((n + halo) / rows)
    blocks = t.withColumn("_own", own).withColumn("_block", F.explode(F.sequence("_own", last)))
    return blocks.withColumn("_halo", F.col("_block") != F.col("_own")).drop("_n", "_own")
