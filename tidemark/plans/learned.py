"""Queries of the model operators: no SQL twin, compared by their invariants in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import series
from ..operators import features, forests, labels, models, splits, stacking, timegrid, windows
from .fixtures import BARS, Inputs
from .registry import query
from .series import full

NAMES = ["x_ret3", "x_z_volume", "x_range"]


def training(s: Inputs) -> DataFrame:
    """Bars with three features and the sign label two rows ahead, without the tail."""
    b = s.bars()
    by = series()
    t = b.withColumns({
        "x_ret3": F.coalesce(F.ln("close") - F.lag(F.ln("close"), 3).over(by), F.lit(0.0)), "x_range": F.col("high") - F.col("low"),
        "x_z_volume": F.col("volume") - F.avg("volume").over(by.rowsBetween(-35, 0)), "id": F.xxhash64("symbol", "ts"),
    })
    return labels.targets(t, 2).select("symbol", "interval", "ts", "id", "close", *NAMES, F.col("target_cls").cast("int").alias("y"))


def split(s: Inputs) -> tuple[DataFrame, DataFrame]:
    t = splits.holdout(training(s), 0.25)
    return t.where("role = 'train'").drop("role"), t.where("role = 'test'").drop("role")


KEYS = ["symbol", "ts"]


@query("ml1_9_boosted_and_scored")
def boosted(s: Inputs) -> DataFrame:
    a, b = split(s)
    return models.scored(b, models.boosted(a, NAMES, "y")).select(*KEYS, "y", "p", "pred")


@query("ml2_early_stopping")
def early(s: Inputs) -> DataFrame:
    a, b = split(s)
    return models.scored(b, models.trained_with_early_stop(a, NAMES, "y")).select(*KEYS, "y", "p", "pred")


@query("ml3_decay_weights")
def decayed(s: Inputs) -> DataFrame:
    a, b = split(s)
    return models.scored(b, models.trained_with_decay(a, NAMES, "y", 14.0)).select(*KEYS, "y", "p", "pred")


@query("ml4_meta_classifier")
def meta(s: Inputs) -> DataFrame:
    _, oof, threshold = models.meta_classifier(training(s), NAMES, "y", 2)
    return oof.select(*KEYS, "fold", "y", "p", "calibrated", F.lit(threshold).alias("threshold"))


@query("ml4_meta_f1")
def meta_scores(s: Inputs) -> DataFrame:
    return models.meta_f1(training(s), NAMES, "y", "id", 2)


@query("ml5_set1_walk_forward_cv")
def walked(s: Inputs) -> DataFrame:
    return models.walk_forward_predictions(splits.expanding(training(s), 2, 2), NAMES, "y")[1]


@query("ml6_calibration")
def calibrated(s: Inputs) -> DataFrame:
    d = s.scored().withColumnRenamed("y_prob", "p")
    a, b = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    iso = models.calibrated(a, b, "y_true").select("doc_id", F.col("calibrated").alias("isotonic"))
    return iso.join(models.calibrated(a, b, "y_true", method="sigmoid").select("doc_id", F.col("calibrated").alias("sigmoid")), "doc_id")


@query("ml7_rolling_recalibration")
def rolling(s: Inputs) -> DataFrame:
    t = training(s).withColumn("p", F.lit(1.0) / (1 + F.exp(-50 * F.col("x_ret3"))))
    return models.rolling_recalibration(t, 60).select(*KEYS, "a", "b")


@query("ml8_stacking")
def stacked(s: Inputs) -> DataFrame:
    t = training(s).withColumns({"model_a": F.lit(1.0) / (1 + F.exp(-50 * F.col("x_ret3"))), "model_b": F.lit(1.0) / (1 + F.exp(-0.1 * F.col("x_z_volume")))})
    return models.stack_predict(t, models.stacked(t, ["model_a", "model_b"], "y")).select(*KEYS, "y", "p")


@query("ml8_stacking_out_of_fold")
def stacked_across(s: Inputs) -> DataFrame:
    """Log loss and Brier score of the calibrated stack, out of fold."""
    t = training(s).withColumns({"model_a": F.lit(1.0) / (1 + F.exp(-50 * F.col("x_ret3"))), "model_b": F.lit(1.0) / (1 + F.exp(-0.1 * F.col("x_z_volume")))})
    _, oof = stacking.cross_fitted(t, ["model_a", "model_b"], "y", "id")
    return stacking.out_of_fold_scores(oof, "y")


@query("ml10_permutation_importance")
def importance(s: Inputs) -> DataFrame:
    a, b = split(s)
    return models.permutation_importance(b, models.boosted(a, NAMES, "y"), NAMES, "y", "id")


@query("ml10_importance_by_regime")
def importance_by_regime(s: Inputs) -> DataFrame:
    """In blocks of a day, within each symbol."""
    a, b = split(s)
    return models.importance_by_regime(b.withColumn("day", F.to_date("ts")), models.boosted(a, NAMES, "y"), NAMES, "y", "id", "symbol", repeats=1, block="day")


@query("ml12_search")
def searched(s: Inputs) -> DataFrame:
    a, _ = split(s)
    m = models.searched(a, NAMES, "y")
    return s.spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.validationMetrics)], "candidate int, roc_auc double")


@query("ml12_halving")
def halved(s: Inputs) -> DataFrame:
    """Ten to eighty trees a candidate (50 to 400 by default)."""
    a, _ = split(s)
    return forests.halving(a, NAMES, "y", "id", least=10, most=80)[0]


@query("ml12_grown_forest")
def grown(s: Inputs) -> DataFrame:
    a, b = split(s)
    forest, scores = forests.grown(a, NAMES, "y", "id", step=10, most=60)
    return forest.scored(b).select(*KEYS, "y", "p", "pred", F.lit(forest.trees).alias("trees"), F.lit(scores[-1]).alias("oob"))


@query("prj8_10_12_feature_matrix")
def matrix(s: Inputs) -> DataFrame:
    out = features.create_features(s.deriv(), features.Settings(step_minutes=60, onchain=False, z_and_delta=False))
    return out.select("symbol", "interval", "ts", *features.feature_columns(out, ["symbol", "interval", "ts", "open", "high", "low", "close"], ["y_", "cls_"]))


@query("halo_blocks_sma", f"SELECT symbol, ts, {full('avg', 'close', 14)} AS sma14 FROM bars", "sma14", ctes=BARS)
def halo(s: Inputs) -> DataFrame:
    t = timegrid.halo_blocks(s.bars(), 256, 13)
    return t.withColumn("sma14", windows.sma(F.col("close"), 14, ("symbol", "interval", "_block"))).where("not _halo").select(*KEYS, "sma14")

