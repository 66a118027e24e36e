"""Window operators that need more than one frame: moving averages with memory, state machines, sequences."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rolling import KEY, filled, mean, rolled, series
from ..sources.shared import written
from .parts import numbered, running


def sma(x: Column, w: int = 14, keys: Sequence[str] = KEY) -> Column:
    return mean(x, w, series(*keys))


def rsi(close: Column, w: int = 14, keys: Sequence[str] = KEY) -> Column:
    """Relative strength by simple means; the first change counts as 0. All gains is 100, no change at all is null."""
    by = series(*keys)
    change = F.coalesce(close - F.lag(close).over(by), F.lit(0.0))
    gain, loss = mean(F.greatest(change, F.lit(0.0)), w, by), mean(F.greatest(-change, F.lit(0.0)), w, by)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, F.lit(100.0))


def ema(df: DataFrame, x: str, span: int, out: str, keys: Sequence[str] = KEY, least: int = 1, block: int = 256) -> DataFrame:
    """One average of :func:`emas`."""
    return emas(df, {out: (x, span)}, keys, least, block)


#: A weight below e^-SMALL (1e-30) forgets all before it; within e^-REACH (1e-200) products stay exact.
SMALL, REACH = 69.0, 460.0


def emas(df: DataFrame, wanted: Mapping[str, tuple[str, int]], keys: Sequence[str] = KEY, least: int = 1, block: int = 256, long: bool = False) -> DataFrame:
    """Exponential moving averages ``y = (1 - a) y + a x`` with ``a = 2 / (span + 1)`` from the first value on; ``wanted``: by name, the column
    and its span (2 or more). All share one pass.

    Each row maps the last average affinely, ``y' = A y + B``; a value ``g`` rows after the one before meets the weight ``d^g`` with ``d = 1 - a``, so
    ``A = d^g / (d^g + a)``; a null changes nothing. Rows are composed by running products and sums inside blocks of ``block`` rows, which
    are cut again where the product gets too small, and begin anew at a value after so many nulls that nothing before it counts. The
    blocks are composed in order, ``block`` of them at a time and then these groups, and the value carried into each joins back. Null before
    the first value and until ``least`` values are there. Rows are numbered by one window over the series; with ``long`` by parts of it, so
    that a series is many tasks' work (its rows are then told apart by ``ts``).
    """
    by, keys, specs = series(*keys), list(keys), list(wanted.items())
    every = range(len(specs))
    t = _placed(df.withColumns({f"_v{i}": F.col(x).cast("double") for i, (_, (x, _)) in enumerate(specs)}), by, keys, len(specs), long)
    t = t.withColumn("_block", F.floor((F.col("_n") - 1) / block))
    for i, (_, (_, span)) in enumerate(specs):
        a, fade = 2.0 / (span + 1), F.pow(F.lit(1 - 2.0 / (span + 1)), (F.col("_n") - F.col(f"_at{i}")).cast("double"))
        weight = F.when(F.col(f"_v{i}").isNull() | F.col(f"_at{i}").isNull(), 1.0).otherwise(fade / (fade + a))
        t = t.withColumn(f"_A{i}", F.when(weight < math.exp(-SMALL), 0.0).otherwise(weight))
        t = t.withColumn(f"_B{i}", F.when(F.col(f"_v{i}").isNull(), 0.0).otherwise((1 - F.col(f"_A{i}")) * F.col(f"_v{i}")))
        t = t.withColumn(f"_L{i}", F.when(F.col(f"_A{i}") > 0, F.ln(f"_A{i}")).otherwise(0.0))
    inside = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    used = lambda i: F.floor(-F.sum(F.when(F.col(f"_A{i}") > 0, F.col(f"_L{i}")).otherwise(-REACH)).over(inside) / REACH)
    t = t.withColumn("_cut", reduce(Column.__add__, [used(i) for i in every]))
    inside = Window.partitionBy(*keys, "_block", "_cut").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"_P{i}": F.exp(F.sum(f"_L{i}").over(inside)) for i in every})
    t = t.withColumns({f"_S{i}": F.col(f"_P{i}") * F.sum(F.col(f"_B{i}") / F.col(f"_P{i}")).over(inside) for i in every})
    t = t.withColumns({f"_P{i}": F.when(F.min(f"_A{i}").over(inside) > 0, F.col(f"_P{i}")).otherwise(0.0) for i in every})  # anew from its first row
    carries = _carried(t, keys, len(specs), block)
    y = {out: F.when(F.col(f"_seen{i}") >= max(1, least), F.col(f"_P{i}") * F.col(f"_carry{i}") + F.col(f"_S{i}")) for i, (out, _) in enumerate(specs)}
    return t.join(carries, [*keys, "_block", "_cut"]).withColumns(y).select(*[c for c in df.columns if c not in wanted], *wanted)


def _placed(t: DataFrame, by: WindowSpec, keys: list[str], n: int, long: bool) -> DataFrame:
    """``t`` with ``_n``, the number of the row, and for each value ``_at``, the number of the last row before that has one, and ``_seen``, how many have."""
    known = [F.col(f"_v{i}").isNotNull() for i in range(n)]
    if long:
        t = t if {"_part", "_n"} <= set(t.columns) else written(numbered(t, keys, ["ts"], "_n"), "numbered")
        t = running(t, keys, ["ts"], **{f"_seen{i}": ("sum", k.cast("long")) for i, k in enumerate(known)})
        return written(running(t, keys, ["ts"], before=True, **{f"_at{i}": ("max", F.when(k, F.col("_n"))) for i, k in enumerate(known)}), "placed")
    t = t.withColumn("_n", F.row_number().over(by))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    here = {f"_at{i}": F.last(F.when(k, F.col("_n")), ignorenulls=True).over(before) for i, k in enumerate(known)}
    return t.withColumns({f"_seen{i}": F.count(f"_v{i}").over(by) for i in range(n)} | here)


def _carried(t: DataFrame, keys: list[str], n: int, block: int) -> DataFrame:
    """``_block, _cut, _carry0, ...``: the average that each block starts from. A group of ``block`` blocks is one row; so are all groups of a series."""
    every = range(n)
    seed = lambda i: F.min_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col("_n")))
    pairs = [F.struct(F.max_by(f"_P{i}", "_n").alias("p"), F.max_by(f"_S{i}", "_n").alias("s"), seed(i).alias("seed")).alias(f"b{i}") for i in every]
    blocks = t.groupBy(*keys, "_block", "_cut").agg(*pairs).withColumn("_group", F.floor(F.col("_block") / block))
    groups = blocks.groupBy(*keys, "_group").agg(F.array_sort(F.collect_list(F.struct("_block", "_cut", *[f"b{i}" for i in every]))).alias("bs"))
    first = lambda bs, i: F.get(F.filter(bs, lambda b: b[f"b{i}"].seed.isNotNull()), F.lit(0))[f"b{i}"].seed
    one = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))
    both = lambda i: F.aggregate("bs", one, lambda acc, b: F.struct((acc.p * b[f"b{i}"].p).alias("p"), (b[f"b{i}"].p * acc.s + b[f"b{i}"].s).alias("s")))
    whole = groups.withColumns({f"_w{i}": both(i) for i in every}).withColumns({f"b{i}": F.struct(F.col(f"_w{i}.p").alias("p"), F.col(f"_w{i}.s").alias("s"), first("bs", i).alias("seed")) for i in every})
    chain = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_group", *[f"b{i}" for i in every]))).alias("gs"))

    def starts(bs: str, i: int, start: Column) -> Column:
        step = lambda acc, b: F.struct((b[f"b{i}"].p * acc.y + b[f"b{i}"].s).alias("y"), F.concat(acc.out, F.array(acc.y)).alias("out"))
        return F.aggregate(bs, F.struct(start.alias("y"), F.expr("cast(array() as array<double>)").alias("out")), step, lambda acc: acc.out)

    chain = chain.select(*keys, F.transform("gs", lambda g: g["_group"]).alias("_group"), *[starts("gs", i, first("gs", i)).alias(f"_start{i}") for i in every])
    chain = chain.select(*keys, F.inline(F.arrays_zip("_group", *[f"_start{i}" for i in every])))
    out = groups.join(chain, [*keys, "_group"])
    out = out.select(*keys, F.transform("bs", lambda b: b["_block"]).alias("_block"), F.transform("bs", lambda b: b["_cut"]).alias("_cut"), *[starts("bs", i, F.col(f"_start{i}")).alias(f"_carry{i}") for i in every])
    return out.select(*keys, F.inline(F.arrays_zip("_block", "_cut", *[f"_carry{i}" for i in every])))


def hysteresis(p: Column, high: float, width: float, keys: Sequence[str] = KEY) -> Column:
    """1 from ``p >= high`` until ``p <= max(0, high - width)``, 0 at first: the last row that switched tells."""
    if width <= 0:
        raise ValueError("the width must be positive")
    switch = F.when(p >= high, 1).when(p <= max(0.0, high - width), 0)
    return F.coalesce(filled(switch, series(*keys)), F.lit(0))


def hour_fill(x: Column, limit: int = 12, keys: Sequence[str] = KEY, fill: float | None = None) -> Column:
    """The last value of the same clock hour, at most ``limit`` rows back (any number if negative)."""
    by = Window.partitionBy(*keys, F.date_trunc("hour", "ts")).orderBy("ts")
    out = F.last(x, ignorenulls=True).over(by.rowsBetween(-limit if limit >= 0 else Window.unboundedPreceding, 0))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def chained_change(df: DataFrame, value: str, change: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Fills a null ``change`` with the percentage since the previous ``value`` if the previous change, filled or not, is known.

    A row breaks the chain if its own change is missing and it cannot be filled: no previous value, a zero one, or none now.
    """
    by = series(*keys)
    before = F.lag(value).over(by)
    can = F.try_divide(F.col(value) - before, before) * 100
    mark = F.when(F.col(change).isNotNull(), 1).when(can.isNull(), 0)
    df = df.withColumns({"_mark": mark, "_can": can})
    known = F.last("_mark", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) == 1
    return df.withColumn(change, F.coalesce(change, F.when(known, F.col("_can")))).drop("_mark", "_can")


def volatility_regime(df: DataFrame, price: str = "close", w: int = 24, calm: float = 0.3, volatile: float = 0.7, keys: Sequence[str] = KEY) -> DataFrame:
    """``volatility`` and ``regime``: rolling deviation of padded changes (half a window is enough, filled backwards) against
    exact quantiles of the whole series."""
    by = series(*keys)
    t = df.withColumn("_f", filled(F.col(price), by))
    t = t.withColumn("_c", F.coalesce(F.try_divide(F.col("_f"), F.lag("_f").over(by)) - 1, F.lit(0.0)))
    t = t.withColumn("volatility", rolled(F.stddev_samp, F.col("_c"), w, by, max(2, w // 2)))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one value for the series: only its head is null
    t = t.withColumn("volatility", F.coalesce("volatility", F.first("volatility", ignorenulls=True).over(whole)))
    limits = t.groupBy(*keys).agg(F.percentile("volatility", F.lit(calm)).alias("_low"), F.percentile("volatility", F.lit(volatile)).alias("_high"))
    regime = F.when(F.col("volatility") <= F.col("_low"), "calm").when(F.col("volatility") >= F.col("_high"), "volatile").otherwise("neutral")
    return t.join(limits, list(keys)).withColumn("regime", regime).select(*df.columns, "volatility", "regime")


def span_mean(x: Column, days: int, keys: Sequence[str] = KEY) -> Column:
    """Mean over the time ``(t - days, t]``."""
    by = Window.partitionBy(*keys).orderBy(F.unix_micros("ts")).rangeBetween(-(days * 86_400_000_000 - 1), 0)
    return F.avg(x).over(by)


def sequences(df: DataFrame, features: Sequence[str], target: str, window: int, horizon: int = 1, keys: Sequence[str] = KEY) -> DataFrame:
    """``window`` rows of features, oldest first, with the target ``horizon`` rows after the last; complete ones only."""
    by = series(*keys)
    rows = F.collect_list(F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in features])).over(by.rowsBetween(-(window - 1), 0))
    t = df.withColumn("sequence", rows).withColumn("label", F.lead(target, horizon).over(by)).withColumn("_later", F.lead("ts", horizon).over(by))
    return t.where((F.size("sequence") == window) & F.col("_later").isNotNull()).select(*keys, "ts", "sequence", "label")


def decay_weight(half_life_days: float, keys: Sequence[str] = KEY) -> Column:
    age = (F.max(F.unix_micros("ts")).over(Window.partitionBy(*keys)) - F.unix_micros("ts")) / 86_400e6
    return F.exp(age * F.lit(-0.6931471805599453 / half_life_days))


def equity(r: Column, keys: Sequence[str] = KEY) -> Column:
    """Running product of ``1 + r``."""
    return F.product(1 + r).over(series(*keys).rowsBetween(Window.unboundedPreceding, 0))
