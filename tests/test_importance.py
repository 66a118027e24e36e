import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.4 * x[:, 1] + 0.3 * rng.normal(size=500) > 0).astype(int)
    data = [(i, "1h", f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00", "u" if i % 3 else "v", *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "id long, interval string, ts string, symbol string, a double, b double, c double, y int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("id") * 3600)).repartition(3)


@pytest.fixture(scope="module")
def model(rows):
    return models.boosted(rows, NAMES, "y", rounds=4, depth=3)


def loop(df, model, block, repeats=3, seed=7):
    """A feature and a repeat at a time."""
    df = df.withColumn("_b", block)
    accuracy = lambda d: models.scored(d, model).agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    base, out = accuracy(df), {}
    for f in NAMES:
        falls = []
        for r in range(repeats):
            a = df.drop(f).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("id")))
            b = df.select("_b", F.col(f), F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("id", F.lit(seed + r)))).alias("_n"))
            falls.append(base - accuracy(a.join(b, ["_b", "_n"])))
        out[f] = (np.mean(falls), np.std(falls))
    return out


def test_importance_equals_the_loop(spark, rows, model):
    df = rows.withColumn("day", F.to_date("ts"))
    got = {r.feature: (r.mean, r.std) for r in models.permutation_importance(df, model, NAMES, "y", "id", block="day").collect()}
    want = loop(df, model, F.col("day"))
    assert all(got[f] == pytest.approx(want[f]) for f in NAMES) and got["a"][0] > got["b"][0] > got["c"][0] - 0.01
    regimes = {(r.symbol, r.feature): r.mean for r in models.importance_by_regime(df.unionByName(df.limit(3).withColumn("symbol", F.lit("few"))), model, NAMES, "y", "id", "symbol", block="day").collect()}
    assert {k[0] for k in regimes} == {"u", "v"}
    one = loop(df.where("symbol = 'v'"), model, F.col("day"))
    assert all(regimes["v", f] == pytest.approx(one[f][0]) for f in NAMES)


def test_jobs_do_not_grow_with_features(spark, rows, model):
    def jobs(names):
        nonlocal rows, model
        spark.sparkContext.setJobGroup(f"i{len(names)}", "")
        models.permutation_importance(rows, model, names, "y", "id", repeats=2).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"i{len(names)}"))

    try:
        few = jobs(NAMES)
        wide = rows.withColumns({f"f{i}": F.col("a") for i in range(20)})
        names = NAMES + [f"f{i}" for i in range(20)]
        model = models.boosted(wide, names, "y", rounds=2, depth=2)
        rows = wide
        assert jobs(names) == few
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_thresholds_from_files(spark, tmp_path):
    models.save_threshold(spark, str(tmp_path / "t"), 0.37)
    assert models.load_threshold(spark, str(tmp_path / "t")) == 0.37
    assert models.load_threshold(spark, str(tmp_path / "none")) == 0.5
    for name, text in (("bad", "{broken"), ("other", '{"x": 1}'), ("far", '{"threshold": 7}'), ("word", '{"threshold": "high"}')):
        spark.createDataFrame([(text,)], "value string").write.text(str(tmp_path / name))
        assert models.load_threshold(spark, str(tmp_path / name)) == 0.5


def test_meta_f1_over_expanding_folds(spark, rows):
    got = {r.fold: r for r in models.meta_f1(rows, NAMES, "y", "id", 2, gap=3, trees=5, depth=4).collect()}
    assert set(got) == {0, 1} and all(0.75 < r.f1 <= 1 for r in got.values()) and sum(r.rows for r in got.values()) >= 300
    none = rows.withColumn("y", (F.col("id") < 4).cast("int"))
    assert all(r.f1 == 0.0 for r in models.meta_f1(none, ["c"], "y", "id", 2, trees=3, depth=2).collect())
