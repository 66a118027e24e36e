"""Backtests, calibration tables, conformal intervals and classification or regression metrics, as aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import KEY, running_sums, series
from .windows import equity

LOW, HIGH = 1e-6, 1 - 1e-6


def clipped(p: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def backtest(df: DataFrame, prob: str | None = None, fee: float = 0.0, slippage_bps: float = 0.0, latency: int = 0, reward: str | None = None, risk: str | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Adds ``price_return, direction, ev, trade_return, equity`` to rows with ``last_price, target`` and ``p_hat`` or ``prob``.

    Without ``prob`` every row trades in the direction of ``p_hat``; with it, a row trades where the expected value of the probability
    (lagged by ``latency``, null is 0, clipped) after costs is positive. Reward and risk are by default the positive and negative part of the return.
    """
    cost, r = fee + slippage_bps / 1e4, F.col("price_return")
    df = df.withColumn("price_return", (F.col("target") - F.col("last_price")) / F.col("last_price"))
    if prob is None:
        df = df.withColumns({"direction": F.when(F.col("p_hat") > F.col("last_price"), 1.0).otherwise(-1.0), "ev": F.lit(0.0)})
    else:
        p = F.lag(prob, latency).over(series(*keys)) if latency else F.col(prob)
        p = clipped(F.coalesce(p.cast("double"), F.lit(0.0)), 0.0, 1.0)
        gain = F.col(reward).cast("double") if reward else F.greatest(r, F.lit(0.0))
        loss = F.col(risk).cast("double") if risk else F.greatest(-r, F.lit(0.0))
        df = df.withColumn("ev", p * gain - (1 - p) * loss - cost).withColumn("direction", F.when(F.col("ev") > 0, 1.0).otherwise(0.0))
    df = df.withColumn("trade_return", F.col("direction") * r - cost * F.abs("direction"))
    return df.withColumn("equity", equity(F.col("trade_return"), keys))


def backtest_metrics(bt: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``pnl, sharpe, trades, hit_rate, avg_ev`` of each series."""
    traded, r = F.abs("direction") > 0, F.col("trade_return")
    return bt.groupBy(*keys).agg(
        (F.max_by("equity", "ts") - 1).alias("pnl"),
        (F.avg(r) / (F.stddev_pop(r) + 1e-9) * F.sqrt(F.count("*"))).alias("sharpe"),
        F.count_if(traded).alias("trades"),
        F.avg(F.when(traded, (F.col("price_return") > 0).cast("double"))).alias("hit_rate"),
        F.avg(F.when(traded, F.col("ev"))).alias("avg_ev"),
    )


def reliability(df: DataFrame, y: str = "y_true", p: str = "y_prob", bins: int = 10) -> DataFrame:
    """``bin, count, avg_pred, avg_true`` for ``bins`` equal bins closed on the right; empty ones have count 0."""
    if bins <= 1:
        raise ValueError("more than one bin is needed")
    c = clipped(F.col(p))
    edges = [i / bins for i in range(1, bins)]
    at = sum((F.when(c > e, 1).otherwise(0) for e in edges), F.lit(0))
    got = df.where(c.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"), F.avg(c).alias("avg_pred"), F.avg(F.col(y).cast("double")).alias("avg_true"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def probability_scores(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates: Brier score and log loss of clipped probabilities."""
    c, y = clipped(p), y.cast("double")
    return {"brier": F.avg((c - y) * (c - y)), "log_loss": F.avg(-(y * F.ln(c) + (1 - y) * F.ln(1 - c)))}


def hit_rates(y: Column, p: Column) -> dict[str, Column]:
    return {"expected": F.avg(p), "actual": F.avg(y.cast("double"))}


def by_regime(df: DataFrame, metrics: Mapping[str, Column], regime: str = "regime") -> DataFrame:
    """Any aggregates by regime, with the row count; all regimes in one pass."""
    return df.groupBy(regime).agg(*[c.alias(n) for n, c in metrics.items()], F.count("*").alias("count"))


def by_regime_python(df: DataFrame, metric: Callable, regime: str = "regime") -> DataFrame:
    """A Python metric of ``(y_true, y_pred)`` by regime: each regime's rows meet in one task, so it is the slow way."""

    def one(pdf):
        import pandas as pd

        return pd.DataFrame({regime: [pdf[regime].iloc[0]], "value": [float(metric(pdf["y_true"], pdf["y_pred"]))], "count": [len(pdf)]})

    return df.groupBy(regime).applyInPandas(one, f"{regime} string, value double, count long")


def order_statistic(df: DataFrame, x: Column, level: Callable[[int], float]) -> float:
    """The value at rank ``ceil((n - 1) level(n))`` (from 0) of ``x``: counts by value, their running sums, and the first that passes the rank."""
    n = df.where(x.isNotNull()).count()
    if not n:
        raise ValueError("no residuals")
    at = level(n)
    if at < 0:
        raise ValueError("too few residuals for this level")
    rank = min(n - 1, math.ceil((n - 1) * at - 1e-12))
    counts = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    return running_sums(counts, "x", ["n"]).where(F.col("n_upto") > rank).agg(F.min("x")).first()[0]


def conformal(calibration: DataFrame, test: DataFrame, y: str, p: str, pred: str, alpha: float = 0.1, touch: bool = False) -> DataFrame:
    """Adds ``lower, upper`` to ``test``: ``pred`` plus and minus the order statistic of the absolute residuals at ``1 - alpha (1 + 1/n)``.

    ``touch``: probabilities are clipped, and the bounds too, to [0, 1].
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    of = clipped if touch else (lambda c: c)
    q = order_statistic(calibration, F.abs(F.col(y) - of(F.col(p))), lambda n: 1 - alpha * (1 + 1 / n))
    low, high = of(F.col(pred)) - q, of(F.col(pred)) + q
    return test.withColumns({"lower": F.greatest(low, F.lit(0.0)) if touch else low, "upper": F.least(high, F.lit(1.0)) if touch else high})


def auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank: counts by value first, then running sums over values."""
    by_value = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    by_value = running_sums(by_value, p, ["neg"], keys)
    return by_value.groupBy(*keys).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def classification(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Confusion counts (``tp, fp, fn, tn``), accuracy, precision, recall, binary and weighted F1."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    f1, f0 = d(2 * tp, 2 * tp + fp + fn), d(2 * tn, 2 * tn + fp + fn)
    total = tp + fp + fn + tn
    return c.select("*", d(tp + tn, total).alias("accuracy"), d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), f1.alias("f1"), d(f1 * (tp + fn) + f0 * (tn + fp), total).alias("f1_weighted"))


def regression(df: DataFrame, y: str, pred: str, keys: Sequence[str] = KEY) -> DataFrame:
    """``rmse, mae, r2, mape`` (denominators of at least 1e-8) and the share of steps whose direction is right."""
    by = series(*keys)
    a, b = F.col(y), F.col(pred)
    sign = lambda x: F.signum(x - F.lag(x).over(by))
    t = df.withColumns({"_right": (sign(a) == sign(b)).cast("double"), "_e": a - b})
    e = F.col("_e")
    return t.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(1e-8))).alias("mape"), F.avg("_right").alias("directional_accuracy"))


def best_threshold(df: DataFrame, y: str, p: str, n: int = 101) -> DataFrame:
    """``threshold, f1``: the first of ``n`` even thresholds with the best F1. Rows are counted by the last threshold they reach,
    so only ``n`` rows meet."""
    at = F.floor(F.round(F.col(p) * (n - 1), 9)).cast("int")
    c = df.groupBy(at.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("k")).join(c, "k", "left").fillna(0)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    whole = Window.partitionBy(F.lit(0))
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    f1 = F.coalesce(F.try_divide(2.0 * tp, tp + fp + F.sum("pos").over(whole)), F.lit(0.0))
    t = every.select("k", f1.alias("f1"))
    return t.orderBy(F.desc("f1"), "k").limit(1).select((F.col("k") / (n - 1)).alias("threshold"), "f1")


def group_importance(importances: DataFrame, group: Column) -> DataFrame:
    """``group, importance, share`` (per cent) from ``feature, importance``."""
    g = importances.groupBy(group.alias("group")).agg(F.sum("importance").alias("importance"))
    return g.withColumn("share", F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy(F.lit(0)))) * 100)


def top_features(importances: DataFrame, n: int, score: str = "importance", horizon: str | None = None) -> DataFrame:
    """The ``n`` best by score, then name."""
    out = importances.orderBy(F.desc(score), "feature").limit(n)
    return out.withColumn("horizon", F.lit(horizon)) if horizon else out


def class_weights(df: DataFrame, y: str, explicit: Mapping[int, float] | None = None) -> DataFrame:
    """``weight``: balanced ``n / (k count)``, or explicit ones (a label without weight is an error)."""
    counts = df.groupBy(y).agg(F.count("*").alias("_n"))
    if explicit is not None:
        if missing := sorted(r[y] for r in counts.collect() if r[y] not in explicit):
            raise KeyError(f"no weight for {missing}")
        table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in explicit.items()], f"{y} int, weight double")
        return df.join(F.broadcast(table), y)  # one row for each class
    every = Window.partitionBy(F.lit(0))
    table = counts.select(y, (F.sum("_n").over(every) / (F.count("*").over(every) * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(table), y)


def positive_scale(y: Column, weight: Column) -> Column:
    """Aggregate: weight of negatives over weight of positives, null if either is 0."""
    neg, pos = (F.sum(F.when(y == k, weight).otherwise(0.0)) for k in (0, 1))
    return F.when((neg > 0) & (pos > 0), neg / pos)
