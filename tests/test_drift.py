import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.sources.shared import written


def plain_psi(a, b, bins=10):
    cuts = sorted(set(np.quantile(a, [i / bins for i in range(1, bins)])))
    x, y = (np.bincount([sum(c <= v for c in cuts) for v in s], minlength=len(cuts) + 1) / len(s) for s in (a, b))
    return sum((q - p) * np.log(q / p) for p, q in zip(x, y, strict=True) if p > 0 and q > 0)


def plain_ks(a, b):
    return max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in {*a, *b})


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    return [(d, float(r.randrange(30) + (d > 5) * 4), r.gauss(0, 1) if r.random() < 0.9 else None) for d in range(10) for _ in range(60)]


def test_spans_are_compared_from_stored_counts(spark, rows, tmp_path):
    source = str(tmp_path / "rows")
    spark.createDataFrame(rows, "day int, x double, y double").write.parquet(source)
    df = spark.read.parquet(source)
    counts = written(drift.daily_counts(df.where("day < 7"), ["x", "y"], F.col("day")).unionByName(drift.daily_counts(df.where("day >= 7"), ["x", "y"], F.col("day"))), "days")
    for first, last in (((0, 3), (7, 9)), ((2, 5), (3, 6))):
        between = drift.between(counts, F.col("day").between(*first), F.col("day").between(*last))
        out = drift.measured(between)
        assert not [f for f in between.inputFiles() + out.inputFiles() if source in f]
        got = {r.feature: r for r in out.collect()}
        for i, name in enumerate("xy", 1):
            a, b = ([r[i] for r in rows if lo <= r[0] <= hi and r[i] is not None] for lo, hi in (first, last))
            assert got[name].ks == pytest.approx(plain_ks(a, b)) and got[name].psi == pytest.approx(plain_psi(a, b))


def test_rows_are_read_once(spark, rows):
    df = written(spark.createDataFrame(rows, "day int, x double, y double").withColumn("is_current", F.col("day") > 4), "rows")
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (reads.add(1), x)[1], "double")
    drift.drift_table(df.withColumn("x", seen("x")), ["x", "y"]).collect()
    assert reads.value == len(rows)


def test_correlations_of_300_features(spark):
    rng, n, k = np.random.default_rng(3), 400, 300
    x = rng.normal(size=(n, k)) + 1e6 * rng.normal(size=k)
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=n) * 0.1
    x[:, 5], x[:, 6] = 7.1, np.where(rng.random(n) < 0.5, 3.3, np.nan)
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 7] = np.nan
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).astype(object).where(~np.isnan(x), None), ", ".join(f"{c} double" for c in names)).repartition(3)
    began = time.time()
    got = {(r.a, r.b): r["corr"] for r in drift.correlations(df, names, block=50).collect()}
    assert time.time() - began < 60 and len(got) == k * (k - 1) // 2
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    for i in range(k):
        for j in range(i + 1, k):
            c = got[names[i], names[j]]
            assert c is None if {i, j} & {5, 6, 7} else c == pytest.approx(want[i, j], abs=1e-9), (i, j, c, want[i, j])
    both = df.select(F.corr(*[F.when(F.col("f0").isNotNull() & F.col("f1").isNotNull(), F.col(c)) for c in ("f0", "f1")])).first()[0]
    assert got["f0", "f1"] == pytest.approx(both, abs=1e-9)


def test_the_order_of_features_decides_who_stays(spark):
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(2, 500))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a + c, "c": c}))
    assert drift.drop_correlated(df, ["a", "b", "c"], 0.6) == ["a", "c"] and drift.drop_correlated(df, ["b", "a", "c"], 0.6) == ["b"]
    assert drift.drop_correlated(df, ["a"], 0.6) == ["a"] and drift.drop_correlated(df.limit(0), ["a", "b"], 0.6) == ["a", "b"]
