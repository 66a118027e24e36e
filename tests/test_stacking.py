import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stacking


def logistic(x, t, s, ridge):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 0.0]
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (s * q * (1 - q))[:, None]).T @ x + np.diag(keep), x.T @ (s * (q - t)) + keep * w)
    return w


def plain(x, t, inner, k, calibrate):
    """The stack of these training rows, as a function of new ones."""
    parts = []
    for i in range(k if calibrate else 1):
        train = inner != i if calibrate else np.full(len(t), True)
        a, y = x[train], t[train]
        m, sd = a.mean(axis=0), a.std(axis=0)
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        w = logistic((a - m) / sd, y, s, 1.0)
        score = lambda z, m=m, sd=sd, w=w: ((z - m) / sd) @ w[:-1] + w[-1]
        c = np.array([1.0, 0.0])
        if calibrate:
            f, y = score(x[~train]), t[~train]
            c = logistic(f[:, None], np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)), np.ones(len(y)), 0.0)
        parts.append(lambda z, score=score, c=c: 1 / (1 + np.exp(-(score(z) * c[0] + c[1]))))
    return lambda z: np.mean([p(z) for p in parts], axis=0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    a, b = (1 / (1 + np.exp(-(2 * y - 1 + rng.normal(0, s, 400)))) for s in (1.5, 2.5))
    data = [(i, float(a[i]), float(b[i]), int(y[i])) for i in range(400)] + [(900, None, 0.5, 1), (901, 0.5, 0.5, None)]
    return spark.createDataFrame(data, "id long, a double, b double, y int").repartition(3)


def test_folds_are_stratified_and_nested(rows):
    t = stacking.fold_table(rows.where("id < 900"), "y", "id", 4).join(rows.select("id", "y"), "id").toPandas()
    assert len(t) == 400 * 4 and (t.outer != t.fold).all()
    for cell in (["fold", "y"], ["outer", "inner", "y"]):
        n = t[t.outer == -1].groupby(cell[:1] + ["y"]).size() if cell[0] == "fold" else t.groupby(cell).size()
        assert (n.groupby([i for i in n.index.names if i not in ("fold", "inner")]).agg(lambda s: s.max() - s.min()) <= 1).all()


@pytest.mark.parametrize("calibrate", [True, False])
def test_out_of_fold_probabilities_equal_plain(rows, calibrate):
    final, oof = stacking.cross_fitted(rows, ["a", "b"], "y", "id", 4, calibrate)
    got = oof.toPandas().set_index("id").sort_index()
    assert len(got) == 400
    t = stacking.fold_table(rows.where("id < 900"), "y", "id", 4).toPandas()
    data = rows.where("id < 900").toPandas().set_index("id")
    want = {}
    for o in range(-1, 4):
        part = t[t.outer == o]
        x, y = data.loc[part.id, ["a", "b"]].to_numpy(), data.loc[part.id, "y"].to_numpy(float)
        predict = plain(x, y, part.inner.to_numpy(), 4, calibrate)
        if o >= 0:
            ids = got.index[got.fold == o]
            want |= dict(zip(ids, predict(data.loc[ids, ["a", "b"]].to_numpy()), strict=True))
        else:
            whole = final.predict(rows.where("id < 900")).toPandas().set_index("id").p
            assert np.allclose(whole.sort_index(), predict(data.sort_index()[["a", "b"]].to_numpy()), atol=1e-7)
    assert np.allclose(got.p, [want[i] for i in got.index], atol=1e-7)
    scores, y = stacking.out_of_fold_scores(oof, "y").first(), data.loc[got.index, "y"].to_numpy()
    q = np.clip(got.p, 1e-5, 1 - 1e-5)
    assert scores.brier == pytest.approx(((got.p - y) ** 2).mean()) and scores.log_loss == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    assert scores.rows == 400 and scores.brier < y.mean() * (1 - y.mean()) or not calibrate


def test_too_few_rows_are_an_error(rows):
    with pytest.raises(ValueError):
        stacking.cross_fitted(rows.where("y = 0"), ["a", "b"], "y", "id", 4)
    with pytest.raises(ValueError):
        stacking.cross_fitted(rows.where((F.col("y") == 0) | (F.col("id") < 8)), ["a", "b"], "y", "id", 4)
