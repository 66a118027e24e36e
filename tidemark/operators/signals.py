"""Rule signals, and their blend with model probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import KEY
from .windows import hysteresis


def below(x: Column, threshold: float = 30.0) -> Column:
    """1 below the threshold, 0 otherwise and for null."""
    return F.when(x < threshold, 1).otherwise(0)


def crossover(short: Column, long: Column) -> Column:
    return F.when(short > long, 1).otherwise(0)


def blended(a: Column, b: Column, wa: float = 1.0, wb: float = 1.0) -> Column:
    return F.when((a * wa + b * wb) / (wa + wb) >= 0.5, 1).otherwise(0)


def with_model(rule: Column, p: Column, how: str = "majority", threshold: float = 0.5, rule_weight: float = 0.5, width: float = 0.1, keys=KEY) -> Column:
    """``majority``: either says yes; ``strict``: both; ``weighted``: the blend of both, with hysteresis."""
    model = F.when(p >= threshold, 1).otherwise(0)
    if how == "majority":
        return F.greatest(rule, model)
    if how == "strict":
        return F.least(rule, model)
    return hysteresis(rule * rule_weight + p * (1 - rule_weight), threshold, width, keys)


def ensemble(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The mean probability of several models (long table ``model, p``)."""
    return predictions.groupBy(*keys).agg(F.avg("p").alias("p"))
