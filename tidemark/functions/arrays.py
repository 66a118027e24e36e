"""Functions over arrays in a row: fee histograms ``(rate, size)`` and order-book levels ``(level, price, size)``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import ratio

HISTOGRAM = "array<struct<rate:double,size:double>>"


def summed(a: Column, f=lambda x: x) -> Column:
    """Sum over an array; nulls are skipped, and 0 without any value."""
    return F.aggregate(F.transform(a, f), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def weighted_mean(hist: Column) -> Column:
    """Mean rate by size; null if there is no weight."""
    w = summed(hist, lambda x: x["size"])
    return F.when(w > 0, summed(hist, lambda x: x["rate"] * x["size"]) / w)


def weighted_percentile(hist: Column, q: float) -> Column:
    """The first rate, from the least, whose cumulative size reaches ``q`` of all; null if there is no weight."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("rate"))

    def reached(total: Column) -> Column:
        def step(acc, x):
            s = acc["sum"] + x["size"]
            return F.struct(s.alias("sum"), F.coalesce(acc["rate"], F.when(s >= total * q, x["rate"])).alias("rate"))

        return F.when(total > 0, F.aggregate(F.array_sort(hist), start, step, lambda acc: acc["rate"]))

    return let(summed(hist, lambda x: x["size"]), reached)


def zipped_histogram(bins: Column, counts: Column) -> Column:
    """Histogram of two arrays of which the longer is cut."""
    n = F.least(F.size(bins), F.size(counts))
    return F.zip_with(F.slice(bins, 1, n), F.slice(counts, 1, n), lambda r, s: F.struct(r.cast("double").alias("rate"), s.cast("double").alias("size")))


def positive(hist: Column) -> Column:
    return F.filter(hist, lambda x: x["rate"].isNotNull() & (x["size"] > 0))


def levels_of(df: DataFrame, side: str) -> Column:
    """``lob_{side}_price_N`` and ``lob_{side}_size_N`` as an array ordered by N as a number."""
    ns = sorted(int(m[1]) for c in df.columns if (m := re.fullmatch(rf"lob_{side}_price_(\d+)", c)) and f"lob_{side}_size_{m[1]}" in df.columns)
    return F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"lob_{side}_price_{n}").cast("double").alias("price"), F.col(f"lob_{side}_size_{n}").cast("double").alias("size")) for n in ns])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def deviation(a: Column) -> Column:
    """The population deviation of an array of numbers, by running updates of mean and squares in its order, as engines' aggregates round it; null
    without any. A value that lies on the edge of so many deviations is then judged as they judge it."""

    def step(acc, x):
        n, off = acc["n"] + 1.0, x - acc["mean"]
        mean = acc["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + off * (x - mean)).alias("squares"))

    return F.aggregate(a, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")]), step, lambda acc: F.sqrt(ratio(acc["squares"], acc["n"])))


def wall(levels: Column, close: Column, side: str = "ask", k: float = 2.0) -> Column:
    """Of the levels whose size is over the mean by ``k`` population deviations, the largest (the first of equals), as a struct: ``dist_bps``, how far
    it lies from ``close`` outward on its ``side``, in basis points, and ``size_rel``, its share of all size. Nulls if there is none."""

    def of(have: Column) -> Column:
        s = summed(have, lambda x: x["size"])
        return let(F.struct(s.alias("sum"), ratio(s, F.size(have)).alias("mean")), lambda m: let(limit(have, m), lambda e: largest(have, m, e)))

    def limit(have: Column, m: Column) -> Column:
        return m["mean"] + k * deviation(F.transform(have, lambda x: x["size"]))

    def largest(have: Column, m: Column, edge: Column) -> Column:
        over = F.filter(have, lambda x: x["size"] > edge)
        most = F.get(F.array_sort(F.transform(over, lambda x: F.struct((-x["size"]).alias("s"), x["level"].alias("level"), x["price"].alias("price")))), F.lit(0))
        return let(most, lambda x: F.struct((ratio((x["price"] - close) if side == "ask" else (close - x["price"]), close) * 1e4).alias("dist_bps"), ratio(-x["s"], m["sum"]).alias("size_rel")))

    return let(F.filter(levels, lambda x: x["size"].isNotNull()), of)


def depth_imbalance(bids: Column, asks: Column) -> Column:
    b, a = summed(bids, lambda x: x["size"]), summed(asks, lambda x: x["size"])
    return ratio(b - a, b + a)


def slope_bps(levels: Column) -> Column:
    """Size-weighted price less the best (first) price, in basis points."""
    mean = lambda x: ratio(summed(x, lambda y: y["price"] * y["size"]), summed(x, lambda y: y["size"]))
    priced = F.filter(levels, lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    best = F.get(levels, F.lit(0))["price"]
    return ratio(let(priced, mean) - best, best) * 1e4
