"""Window helpers: a frame of ``w`` rows gives a value only when all ``w`` are there and not null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("symbol", "interval")


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or KEY)).orderBy(order)


def rolled(agg: Callable[[Column], Column], x: Column, w: int, by: WindowSpec, least: int | None = None) -> Column:
    f = by.rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(f) >= (w if least is None else least), agg(x).over(f))


def mean(x: Column, w: int, by: WindowSpec, least: int | None = None) -> Column:
    return rolled(F.avg, x, w, by, least)


def total(x: Column, w: int, by: WindowSpec) -> Column:
    return rolled(F.sum, x, w, by)


def deviation(x: Column, w: int, by: WindowSpec, least: int | None = None) -> Column:
    """Sample deviation; null for fewer than two values."""
    return rolled(F.stddev_samp, x, w, by, least)


def z_score(x: Column, w: int, by: WindowSpec) -> Column:
    return F.try_divide(x - mean(x, w, by), deviation(x, w, by))


def delta(x: Column, by: WindowSpec, k: int = 1) -> Column:
    return x - F.lag(x, k).over(by)


def filled(x: Column, by: WindowSpec) -> Column:
    """The last value that is not null, up to the row."""
    return F.last(x, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))


def correlation(x: Column, y: Column, w: int, by: WindowSpec) -> Column:
    """Rolling Pearson correlation over complete frames; null where either side is constant."""
    f, both = by.rowsBetween(-(w - 1), 0), F.when(x.isNotNull() & y.isNotNull(), 1)
    varies = (F.max(x).over(f) > F.min(x).over(f)) & (F.max(y).over(f) > F.min(y).over(f))
    return F.when((F.count(both).over(f) == w) & varies, F.corr(x, y).over(f))


def running_sums(counts: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """Adds ``{c}_upto``, the sum of each of ``sums`` over all rows of the key up to ``value`` (one row for each value).

    Two steps: inside each of about ``parts`` value ranges, and over the sums of the ranges, so that no task holds all values of a key.
    """
    keys = list(keys)
    t = counts.withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    edges = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000))
    t = t.join(t.groupBy("_key").agg(edges.alias("_edges")), "_key").withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy("_key", "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = before.select("_key", "_part", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_key", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(before, ["_key", "_part"])
    return t.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in sums}).select(*counts.columns, *[f"{c}_upto" for c in sums])
