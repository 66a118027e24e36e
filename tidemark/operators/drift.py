"""Drift between a reference and a current sample, for all features at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .parts import in_parts, running


def unpivoted(df: DataFrame, features: Sequence[str], current: str = "is_current") -> DataFrame:
    """``feature, value, is_current`` rows from wide ones; nulls go."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.col(current).alias("is_current"), F.inline(pairs)).where("value is not null")


def daily_counts(df: DataFrame, features: Sequence[str], day: Column) -> DataFrame:
    """``feature, value, day, n``: how often each value occurs on each day. Stored, it stands for the rows: the counts of more days are appended, and
    any two spans of days are compared from it (:func:`between`)."""
    return unpivoted(df.withColumn("_day", day), features, "_day").groupBy("feature", "value", F.col("is_current").alias("day")).agg(F.count("*").alias("n"))


def unpivoted_counts(long: DataFrame) -> DataFrame:
    """``feature, value, a, b``: how often each value occurs in the reference (a) and the current sample (b)."""
    return long.groupBy("feature", "value").agg(F.count_if(~F.col("is_current")).alias("a"), F.count_if("is_current").alias("b"))


def between(counts: DataFrame, reference: Column, current: Column) -> DataFrame:
    """The same from stored daily counts, of the days for which ``reference`` and ``current`` hold (a day may be in both)."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return counts.where(reference | current).groupBy("feature", "value").agg(n(reference).alias("a"), n(current).alias("b"))


def by_value(counts: DataFrame) -> DataFrame:
    """``feature, value, a, b, a_upto, b_upto, na, nb``: :func:`unpivoted_counts` with running and whole sums; written, as all measures read it.

    The counts are written, then dealt by feature and value over many tasks, so no task gets all values of a feature.
    """
    c = in_parts(written(counts, "counts"), ["feature"], ["value"])
    sizes = c.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    summed = running(c, ["feature"], ["value"], a_upto=("sum", F.col("a")), b_upto=("sum", F.col("b"))).drop("_part")
    return written(summed.join(F.broadcast(sizes), "feature"), "compared")  # one row for each feature


def reference_cuts(counts: DataFrame, bins: int) -> DataFrame:
    """``feature, cuts``: the exact quantiles of the reference, between ranks by the straight line; between equal values exactly these, so that a value
    never falls below a cut made of it."""
    at = {i: (F.col("na") - 1) * F.lit(i / bins) for i in range(1, bins)}
    low = {i: F.min(F.when(F.col("a_upto") > F.floor(x), F.col("value"))) for i, x in at.items()}
    high = {i: F.min(F.when(F.col("a_upto") > F.ceil(x), F.col("value"))) for i, x in at.items()}
    t = counts.where("a > 0").groupBy("feature", "na").agg(*[c.alias(f"l{i}") for i, c in low.items()], *[c.alias(f"h{i}") for i, c in high.items()])
    between = lambda i, x: F.when(F.ceil(x) == F.floor(x), F.col(f"l{i}")).otherwise(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (x - F.floor(x)))
    return t.select("feature", F.array_distinct(F.array(*[between(i, x) for i, x in at.items()])).alias("cuts"))


def _psi(counts: DataFrame, bins: int) -> DataFrame:
    t = counts.join(F.broadcast(reference_cuts(counts, bins)), "feature")  # a few numbers for each feature
    c = t.groupBy("feature", F.size(F.filter("cuts", lambda e: e <= F.col("value"))).alias("bin"), "na", "nb").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    c = c.withColumns({"pa": F.try_divide("a", F.col("na")), "pb": F.try_divide("b", F.col("nb"))})
    term = F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))).otherwise(0.0)
    return c.groupBy("feature").agg(F.when((F.max("na") > 0) & (F.max("nb") > 0), F.sum(term)).alias("psi"))


def _ks(counts: DataFrame) -> DataFrame:
    gap = F.abs(F.try_divide("a_upto", F.col("na")) - F.try_divide("b_upto", F.col("nb")))
    return counts.groupBy("feature").agg(F.max(gap).alias("ks"))


def psi(long: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, psi``: bins between exact quantiles of the reference with open ends, summed where both samples have rows;
    null if either sample is empty."""
    counts = by_value(unpivoted_counts(long))
    return counts.select("feature").distinct().join(_psi(counts, bins), "feature", "left")


def ks(long: DataFrame) -> DataFrame:
    """``feature, ks``: the largest distance of the two distribution functions, from counts by value and their running sums."""
    return _ks(by_value(unpivoted_counts(long)))


def measured(counts: DataFrame, psi_alert: float = 0.2, ks_alert: float = 0.1) -> DataFrame:
    """``feature, psi, ks, psi_alert, ks_alert`` of :func:`unpivoted_counts` or :func:`between`; without a value there is no alert."""
    values = by_value(counts)
    t = _ks(values).join(_psi(values, 10), "feature", "left")
    alert = lambda c, x: F.coalesce(F.col(c) > x, F.lit(False)).alias(f"{c}_alert")
    return t.select("feature", "psi", "ks", alert("psi", psi_alert), alert("ks", ks_alert))


def drift_table(df: DataFrame, features: Sequence[str], current: str = "is_current", psi_alert: float = 0.2, ks_alert: float = 0.1) -> DataFrame:
    """:func:`measured` of the rows of ``df``, which are read once."""
    return measured(unpivoted_counts(unpivoted(df, features, current)), psi_alert, ks_alert)


def correlations(df: DataFrame, features: Sequence[str], block: int = 64) -> DataFrame:
    """``a, b, corr`` for each pair (a before b), over rows where both are there; null where either does not vary there.

    Each task adds up, for blocks of ``block`` by ``block`` columns at a time, how many rows have both, and sums, squares and products over them; the
    tasks' numbers are summed by pair. Values are taken from one of the column's own, so sums stay exact where it does not vary. Rows are read
    twice, whatever the number of features, and the plan does not grow with the pairs.
    """
    names, k = list(features), len(features)
    wide = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(names)])
    base = wide.agg(*[F.max_by(f"c{i}", F.when(F.col(f"c{i}").isNotNull(), F.xxhash64(f"c{i}"))).alias(f"c{i}") for i in range(k)]).first()
    shift = np.array([0.0 if x is None else x for x in base])
    row = wide.select(F.array(*wide.columns).alias("x"))
    fields = ["n", "sa", "sb", "qa", "qb", "p"]

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(fields), k, k))
        for f in frames:
            x = np.array(f.x.to_list(), float).reshape(len(f), k) - shift
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            for i in range(0, k, block):
                a, ma = x[:, i : i + block].T, m[:, i : i + block].T
                for j in range(i, k, block):
                    b, mb = x[:, j : j + block], m[:, j : j + block]
                    part = ma @ mb, a @ mb, ma @ b, (a * a) @ mb, ma @ (b * b), a @ b
                    for to, add in zip(sums, part, strict=True):
                        to[i : i + block, j : j + block] += add
        a, b = np.triu_indices(k, 1)
        if len(a):
            yield pd.DataFrame({"a": a, "b": b} | {name: s[a, b] for name, s in zip(fields, sums, strict=True)})

    each = row.mapInPandas(added, "a int, b int, " + ", ".join(f"{n} double" for n in fields))
    t = each.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in fields])
    va, vb = (F.col(f"q{x}") - F.try_divide(F.col(f"s{x}") * F.col(f"s{x}"), "n") for x in "ab")
    corr = F.when((va > 0) & (vb > 0), (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va) / F.sqrt(vb))
    name = lambda c: F.get(F.array(*map(F.lit, names)), F.col(c))
    return t.select(name("a").alias("a"), name("b").alias("b"), F.when(corr.isNotNull(), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def drop_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """The features that stay: each one whose correlation with an earlier one that stays is over the threshold goes. Only the
    matrix of the features comes to the driver."""
    corr = {(r.a, r.b): abs(r["corr"]) for r in correlations(df, features).collect() if r["corr"] is not None}
    kept: list[str] = []
    for f in features:
        if not any(corr.get((k, f), 0.0) > threshold for k in kept):
            kept.append(f)
    return kept
