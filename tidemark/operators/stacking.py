"""Stacking with nested calibration, cross-fitted: one table of outer and inner folds, and all models of it fitted side by side.

A model here has as many numbers as there are base models, and there are ``k (k + 1)`` of them. So each Newton step of all of them is one
grouped aggregation over the rows, and only sums (a row a model) come to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .evaluate import clipped
from .splits import class_ranks, stratified_kfold

#: The outer fold that leaves nothing out: its models are the final ones.
ALL = -1


def fold_table(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``key, outer, inner``: for each outer fold (and for :data:`ALL`) its training rows, each with its fold among ``k`` inner ones; stratified by class.
    A row is in the training part of all outer folds but its own (``fold``)."""
    folds = stratified_kfold(df.select(key, label), label, key, k, seed)
    outer = F.explode(F.filter(F.sequence(F.lit(ALL), F.lit(k - 1)), lambda o: o != F.col("fold"))).alias("outer")
    rows = folds.select(key, label, "fold", outer).withColumn("_cell", F.concat_ws(":", "outer", label))
    return class_ranks(rows, "_cell", key, seed + 1).select(key, "fold", "outer", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("inner"))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def by_group(values: Mapping[int, Sequence[float]], g: Column) -> Column:
    """The array of a row's group, as a literal: a few numbers for each model."""
    return F.get(F.array(*[F.array(*map(F.lit, map(float, values[i]))) for i in range(len(values))]), g)


def logistic_groups(rows: DataFrame, groups: int, p: int, ridge: float, steps: int = 30, close: float = 1e-9) -> dict[int, np.ndarray]:
    """For each group ``g`` (0 to ``groups - 1``) the weights and, last, the intercept of a logistic regression of ``t`` (0 to 1) on ``x`` (``p`` numbers) with
    weights ``s``: the least of the weighted log loss plus ``ridge / 2`` times the squared weights. ``rows`` is a written table, read once a step."""
    w = {g: np.zeros(p + 1) for g in range(groups)}
    x = [F.get("x", F.lit(i)) for i in range(p)] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    for _ in range(steps):
        mine = by_group(w, F.col("g"))
        at = F.lit(1.0) / (1 + F.exp(-(dot(F.col("x"), F.slice(mine, 1, p)) + F.get(mine, F.lit(p)))))
        now = rows.withColumn("_q", at).withColumns({"_r": F.col("s") * (F.col("_q") - F.col("t")), "_h": F.col("s") * F.col("_q") * (1 - F.col("_q"))})
        sums = now.groupBy("g").agg(*[F.sum(F.col("_r") * c).alias(f"r{i}") for i, c in enumerate(x)], *[F.sum(F.col("_h") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs])
        moved = 0.0
        for r in sums.collect():  # one row for each group
            hess, grad = np.zeros((p + 1, p + 1)), np.array([r[f"r{i}"] for i in range(p + 1)])
            for i, j in pairs:
                hess[i, j] = hess[j, i] = r[f"h{i}_{j}"]
            hess[range(p), range(p)] += ridge
            grad[:p] += ridge * w[r.g][:p]
            step = np.linalg.solve(hess + 1e-12 * np.eye(p + 1), grad)
            step *= min(1.0, 10.0 / max(1e-12, np.abs(step).max()))
            w[r.g] = w[r.g] - step
            moved = max(moved, np.abs(step).max())
        if moved < close:
            break
    return w


@dataclass
class Stack:
    """The mean of several calibrated logistic models over standardised base predictions."""

    models: list[str]
    centre: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray] | None

    def probability(self, x: Column) -> Column:
        """Of an array of the base models' predictions."""
        each = []
        for i, w in enumerate(self.weights):
            by = w[:-1] / self.scale[i]
            score = dot(x, F.array(*map(F.lit, map(float, by)))) + float(w[-1] - (by * self.centre[i]).sum())
            if self.calibration is not None:
                a, b = map(float, self.calibration[i])
                score = score * a + b
            each.append(F.lit(1.0) / (1 + F.exp(-score)))
        return sum(each[1:], each[0]) / len(each)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", self.probability(predictions(self.models)))


def predictions(models: Sequence[str]) -> Column:
    return F.array(*[F.col(m).cast("double") for m in models])


def cross_fitted(df: DataFrame, models: Sequence[str], label: str, key: str, k: int = 5, calibrate: bool = True, c: float = 1.0, seed: int = 42) -> tuple[Stack, DataFrame]:
    """The final stack, and ``key, label, fold, p``: each row's probability by the stack that was fitted without its outer fold.

    A stack is the mean of ``k`` models; each is fitted on all inner folds but one (balanced class weights, standardised over these rows, squared
    weights at 1 / ``c``) and, with ``calibrate``, brought to probabilities on the one that it has not seen: a logistic curve of its score
    towards Platt's targets. Without ``calibrate`` a stack is one model of all its rows. ``key`` tells rows apart; rows with a null prediction or
    label take no part. Too few rows of a class for ``k`` folds are an error.
    """
    whole = df.where(F.col(label).isNotNull() & F.forall(predictions(models), lambda v: v.isNotNull()))
    data = written(whole.select(key, F.col(label).cast("double").alias("t"), predictions(models).alias("x")), "stacking")
    counts = {r.t: r["count"] for r in data.groupBy("t").count().collect()}
    if len(counts) < 2 or min(counts.values()) < 2 * k:
        raise ValueError(f"two classes of {2 * k} rows or more are needed: {counts}")
    p, inner = len(models), k if calibrate else 1
    folds = fold_table(data, "t", key, k, seed)
    group = lambda o, i: (o + 1) * inner + i
    # each row once for every model of its outer fold: trained on, or held for the calibration
    held = (F.col("m") == F.col("inner")) & F.lit(calibrate)
    m = F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("m")
    rows = folds.select(key, "outer", "inner", m).select(key, group(F.col("outer"), F.col("m")).cast("int").alias("g"), held.alias("held")).join(data, key)
    rows = written(rows, "rows")
    n = (k + 1) * inner
    moments = rows.where("not held").groupBy("g").agg(F.count_if(F.col("t") == 1).alias("n1"), F.count_if(F.col("t") == 0).alias("n0"), *[f(F.get("x", F.lit(i))).alias(f"{name}{i}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(p)])
    known = {r.g: r for r in moments.collect()}  # one row for each model
    centre = {g: np.array([known[g][f"m{i}"] for i in range(p)]) for g in range(n)}
    scale = {g: np.array([known[g][f"s{i}"] or 1.0 for i in range(p)]) for g in range(n)}
    balance = {g: [(r.n0 + r.n1) / (2 * r.n0), (r.n0 + r.n1) / (2 * r.n1)] for g, r in known.items()}
    standard = F.zip_with(F.zip_with("x", by_group(centre, F.col("g")), lambda a, b: a - b), by_group(scale, F.col("g")), lambda a, b: a / b)
    ready = written(rows.select(key, "g", "held", "t", standard.alias("x"), F.get(by_group(balance, F.col("g")), F.col("t").cast("int")).alias("s")), "standard")
    weights = logistic_groups(ready.where("not held"), n, p, 1.0 / c)
    calibration = None
    if calibrate:
        mine = by_group(weights, F.col("g"))
        score = dot(F.col("x"), F.slice(mine, 1, p)) + F.get(mine, F.lit(p))
        scored = written(ready.where("held").select("g", "t", F.array(score).alias("x")), "scores")
        sizes = {r.g: (r.n0, r.n1) for r in scored.groupBy("g").agg(F.count_if(F.col("t") == 0).alias("n0"), F.count_if(F.col("t") == 1).alias("n1")).collect()}
        targets = {g: [1.0 / (n0 + 2), (n1 + 1.0) / (n1 + 2)] for g, (n0, n1) in sizes.items()}
        soft = scored.select("g", "x", F.get(by_group(targets, F.col("g")), F.col("t").cast("int")).alias("t"), F.lit(1.0).alias("s"))
        calibration = logistic_groups(soft, n, 1, 0.0)
    pick = lambda table, o: [table[group(o, i)] for i in range(inner)]
    stacks = {o: Stack(list(models), pick(centre, o), pick(scale, o), pick(weights, o), pick(calibration, o) if calibration else None) for o in range(ALL, k)}
    out = folds.where(F.col("outer") == ALL).select(key, "fold").join(data, key)
    probability = F.lit(None).cast("double")
    for o in range(k):
        probability = F.when(F.col("fold") == o, stacks[o].probability(F.col("x"))).otherwise(probability)
    return stacks[ALL], written(out.select(key, F.col("t").alias(label), "fold", probability.alias("p")), "out_of_fold")


def out_of_fold_scores(oof: DataFrame, label: str) -> DataFrame:
    """One row: ``log_loss`` (probabilities kept 1e-5 from 0 and 1), ``brier``, ``rows``."""
    y, q = F.col(label).cast("double"), clipped(F.col("p"), 1e-5, 1 - 1e-5)
    return oof.agg(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.count("*").alias("rows"))
