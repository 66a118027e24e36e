"""Classifiers and regressors on MLlib: training, walk-forward evaluation, calibration, stacking, scoring, importance."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import KEY
from ..sources.shared import written
from . import evaluate, splits
from .windows import decay_weight


def assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def boosted(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.1, validation: str | None = None, regression: bool = False, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees; ``validation`` names a boolean column whose rows stop the boosting early."""
    args = dict(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    args |= {"weightCol": weight} if weight else {}
    args |= {"validationIndicatorCol": validation, "validationTol": 1e-4} if validation else {}
    return Pipeline(stages=[assembled(features), (GBTRegressor if regression else GBTClassifier)(**args)]).fit(df)


def trained_with_early_stop(df: DataFrame, features: Sequence[str], label: str, last_rows: int | None = None, fraction: float = 0.2, **options) -> PipelineModel:
    """Boosted trees on the last ``last_rows`` rows of each series, whose last ``fraction`` stop the boosting."""
    t = splits.positions(df)
    if last_rows:
        t = t.where(F.col("_pos") >= F.col("_rows") - last_rows)
    t = splits.holdout(t.drop("_pos", "_rows"), fraction).withColumn("_late", F.col("role") == "test")
    return boosted(t, features, label, validation="_late", **options)


def trained_with_decay(df: DataFrame, features: Sequence[str], label: str, half_life_days: float = 30.0, **options) -> PipelineModel:
    return boosted(df.withColumn("_w", decay_weight(half_life_days)), features, label, weight="_w", **options)


def forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 30, depth: int = 6, seed: int = 7) -> PipelineModel:
    return Pipeline(stages=[assembled(features), RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]).fit(df)


def scored(df: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """``p`` and ``pred`` of each row; an error names the features that are missing."""
    needed = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    if missing := sorted(set(needed) - set(df.columns)):
        raise KeyError(f"missing features: {missing}")
    out = model.transform(df)
    out = out.withColumn("p", vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction"))
    return out.withColumn("pred", F.when(F.col("p") >= threshold, 1).otherwise(0)).drop("features", "rawPrediction", "probability", "prediction")


def walk_forward_predictions(folds: DataFrame, features: Sequence[str], label: str, fit=boosted, **options) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions, and metrics by fold: one fit for each fold (``fold, role`` as the splits give them)."""
    folds = written(folds, "folds")
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        one = folds.where(F.col("fold") == k)
        got = scored(one.where("role = 'test'"), fit(one.where("role = 'train'"), features, label, **options))
        out = got if out is None else out.unionByName(got)
    hit = (F.col("pred") == F.col(label)).cast("double")
    return out, out.groupBy("fold").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("count"), *[c.alias(n) for n, c in evaluate.probability_scores(F.col(label), F.col("p")).items()])


def calibrated(fit_on: DataFrame, apply_to: DataFrame, label: str, p: str = "p", method: str = "isotonic") -> DataFrame:
    """Adds ``calibrated``: isotonic regression (clipped outside its range), Platt's logistic, or none."""
    if method == "none":
        return apply_to.withColumn("calibrated", F.col(p))
    if method == "isotonic":
        m = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(fit_on.withColumn(label, F.col(label).cast("double")))
        return m.transform(apply_to)
    if method != "sigmoid":
        raise ValueError("method is none, isotonic or sigmoid")
    n = fit_on.count()
    va = VectorAssembler(inputCols=[p], outputCol="_f")
    m = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / max(n, 1), standardization=False, probabilityCol="_pr", rawPredictionCol="_raw", predictionCol="_pred").fit(va.transform(fit_on))
    return m.transform(va.transform(apply_to)).withColumn("calibrated", vector_to_array("_pr")[1]).drop("_f", "_pr", "_raw", "_pred")


def rolling_recalibration(df: DataFrame, window: int, p: str = "p", y: str = "y", keys: Sequence[str] = KEY) -> DataFrame:
    """``ts, a, b``: a logistic calibrator ``1 / (1 + exp(-(a p + b)))`` for each window of ``window`` rows with both classes.

    Newton's steps with a ridge of 1 on ``a`` only (the usual C of 1), for all windows of a batch at once.
    """
    import numpy as np
    import pandas as pd

    by = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(window - 1), 0)
    pairs = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    both = (F.min(y).over(by) < F.max(y).over(by)).alias("both")
    rows = pairs.select(*keys, "ts", *[F.collect_list(F.col(c).cast("double")).over(by).alias(n) for c, n in ((p, "x"), (y, "t"))], both).where((F.size("x") == window) & F.col("both")).drop("both")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x, t = (np.stack(f[c].to_list()).astype(float) for c in ("x", "t"))
            a, b = np.zeros(len(f)), np.zeros(len(f))
            for _ in range(25):
                q = 1 / (1 + np.exp(-(a[:, None] * x + b[:, None])))
                w = q * (1 - q)
                ga, gb = (x * (q - t)).sum(axis=1) + a, (q - t).sum(axis=1)
                haa, hab, hbb = (w * x * x).sum(axis=1) + 1.0, (w * x).sum(axis=1), w.sum(axis=1) + 1e-9
                det = haa * hbb - hab * hab
                da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
                a, b = a - da, b - db
                if max(abs(da).max(), abs(db).max()) < 1e-10:
                    break
            yield f.drop(columns=["x", "t"]).assign(a=a, b=b)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("x", "t").schema) + ", a double, b double"
    return rows.mapInPandas(fit, schema)


def stacked(df: DataFrame, models: Sequence[str], label: str) -> PipelineModel:
    """A balanced logistic regression over the standardised probabilities of several models."""
    t = evaluate.class_weights(df, label)
    stages = [VectorAssembler(inputCols=list(models), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1e-3)]
    return Pipeline(stages=stages).fit(t)


def stack_predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def permutation_importance(df: DataFrame, model: PipelineModel, features: Sequence[str], label: str, key: str, repeats: int = 3, block: str | None = None, seed: int = 7, by: str | None = None, block_rows: int = 50_000) -> DataFrame:
    """``feature, mean, std``: how far accuracy falls when a feature's values are dealt anew among the rows of a block; with ``by`` for each of its
    values, of which each has blocks of its own.

    A permutation puts row numbers in order of ``key`` against those in order of a hash, within ``block`` (without one: 64 blocks by hash, or
    one for each ``block_rows`` rows if these are more). All features and repeats are copies of one join, scored in one pass, so the number of
    jobs is the same for any number of features.
    """
    names, group = list(features), [by] if by else []
    place = F.col(block) if block else F.pmod(F.xxhash64(key), F.lit(max(64, df.count() // block_rows)))
    t = df.withColumn("_b", F.struct(place.alias("b"), *group))
    rank = lambda *order: F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    orders = F.array(*[rank(F.xxhash64(key, F.lit(seed + r))) for r in range(repeats)])
    t = written(t.select(*group, label, "_b", *names, rank(key).alias("_n"), orders.alias("_orders")), "permuted")
    other = t.select("_b", F.posexplode("_orders").alias("_r", "_n"), F.struct(*names).alias("_other"))
    pairs = t.drop("_orders").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).join(other, ["_b", "_r", "_n"])
    copies = pairs.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1)))).where("_f >= 0 or _r = 0")  # -1: as it is
    copies = copies.withColumns({f: F.when(F.col("_f") == i, F.col("_other")[f]).otherwise(F.col(f)) for i, f in enumerate(names)})
    hits = scored(copies, model).groupBy(*group, "_f", "_r").agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("hits"))
    hits = written(hits, "hits")  # one row for each feature and repeat
    base = hits.where("_f < 0").select(*[F.col(g).alias("_g") for g in group], F.col("hits").alias("base"))
    falls = hits.where("_f >= 0").join(F.broadcast(base), F.col(by).eqNullSafe(F.col("_g")) if by else F.lit(True))
    feature = F.get(F.array(*map(F.lit, names)), F.col("_f")).alias("feature")
    return falls.groupBy(*group, feature).agg(F.avg(F.col("base") - F.col("hits")).alias("mean"), F.stddev_pop(F.col("base") - F.col("hits")).alias("std"))


def importance_by_regime(df: DataFrame, model: PipelineModel, features: Sequence[str], label: str, key: str, regime: str, least: int = 5, **options) -> DataFrame:
    """Permutation importance within each regime of ``least`` rows or more, all regimes in one pass."""
    many = df.groupBy(regime).agg(F.count("*").alias("_many")).where(F.col("_many") >= least).select(regime)
    out = permutation_importance(df.join(F.broadcast(many), regime), model, features, label, key, by=regime, **options)  # one row for each regime
    return out.select("feature", "mean", "std", regime)


def save(model: PipelineModel, path: str, features: Sequence[str], **metadata) -> None:
    """The model, and beside it a JSON text with its features and what else is given."""
    model.write().overwrite().save(f"{path}/model")
    spark = metadata.pop("spark")
    text = json.dumps({"features": list(features), **metadata}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def save_threshold(spark, path: str, threshold: float) -> None:
    """The decision threshold as a JSON text of its own."""
    spark.createDataFrame([(json.dumps({"threshold": float(threshold)}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_threshold(spark, path: str, otherwise: float = 0.5) -> float:
    """The threshold that ``path`` holds; ``otherwise`` where there is no such text, or none with a number from 0 to 1."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException:
        return otherwise
    value = rows and spark.range(1).select(F.try_variant_get(F.try_parse_json(F.lit(rows[0].value)), "$.threshold", "double")).first()[0]
    return value if isinstance(value, float) and 0 <= value <= 1 else otherwise


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def searched(df: DataFrame, features: Sequence[str], label: str, depths: Sequence[int] = (3, 5), trees: Sequence[int] = (10, 20), seed: int = 7):
    """The best random forest over a grid, by ROC AUC on a held-out part; candidates are fitted side by side."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()
    tvs = TrainValidationSplit(estimator=rf, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), trainRatio=0.8, parallelism=4, seed=seed)
    return tvs.fit(assembled(features).transform(df))


def calibrated_forest(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, method: str = "sigmoid", inner: int = 3, **options) -> DataFrame:
    """``test`` with ``p``: the mean of ``inner`` forests, each fitted on all stratified folds of ``train`` but one and calibrated on that one."""
    folds = written(splits.stratified_kfold(train, label, key, inner), "inner")
    out = test.withColumn("_sum", F.lit(0.0))
    for i in range(inner):
        model = forest(folds.where(F.col("fold") != i), features, label, **options)
        held = scored(folds.where(F.col("fold") == i).drop("fold"), model).select(label, "p")
        out = calibrated(held, scored(out, model), label, method=method).withColumn("_sum", F.col("_sum") + F.col("calibrated")).drop("p", "pred", "calibrated")
    return out.withColumn("p", F.col("_sum") / inner).drop("_sum")


def meta_f1(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, gap: int = 0, many: int = 50_000, **options) -> DataFrame:
    """``fold, f1`` over expanding folds with ``gap`` rows between: the binary F1, at a half, of :func:`calibrated_forest` on the fold's training rows (isotonic
    if all rows are over ``many``). 0 where nothing is positive. Its mean is the score of the meta classifier."""
    method = "isotonic" if df.count() > many else "sigmoid"
    folds, out = written(splits.expanding(df, k, gap), "folds"), None
    for i in range(k):
        one = folds.where(F.col("fold") == i)
        got = calibrated_forest(one.where("role = 'train'").drop("fold", "role"), one.where("role = 'test'"), features, label, key, method, **options)
        got = got.select("fold", F.col(label).alias("y"), (F.col("p") >= 0.5).cast("int").alias("pred"))
        out = got if out is None else out.unionByName(got)
    n = lambda a, b: F.count_if((F.col("y") == a) & (F.col("pred") == b))
    f1 = F.try_divide(2.0 * n(1, 1), 2 * n(1, 1) + n(0, 1) + n(1, 0))
    return out.groupBy("fold").agg(F.coalesce(f1, F.lit(0.0)).alias("f1"), F.count("*").alias("rows"))


def meta_classifier(df: DataFrame, features: Sequence[str], label: str, k: int = 3, many: int = 50_000) -> tuple[PipelineModel, DataFrame, float]:
    """A random forest, its calibrated out-of-fold predictions over expanding folds, and the threshold of best F1."""
    folds = splits.expanding(df, k)
    out, _ = walk_forward_predictions(folds, features, label, fit=forest)
    out = written(out, "folds")
    method = "isotonic" if out.count() > many else "sigmoid"
    oof = calibrated(out, out, label, method=method)
    return forest(df, features, label), oof, evaluate.best_threshold(oof, label, "calibrated").first().threshold
