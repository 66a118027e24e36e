import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import forests


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.4 * rng.normal(size=600) > 0.4).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y int").repartition(3)


NAMES = ["a", "b", "c", "d"]


def plain_accuracy(forest, df):
    """From each batch's probabilities of all rows, and who was in its bag."""
    total, count, label = {}, {}, {}
    for i, m in enumerate(forest.batches):
        got = m.transform(forests.vectors(df, NAMES)).select("id", "y", vector_to_array("probability")[1].alias("p"), forest.bagged(i).alias("seen"))
        for r in got.collect():
            label[r.id] = r.y
            if not r.seen:
                total[r.id] = total.get(r.id, 0) + r.p * m.getNumTrees
                count[r.id] = count.get(r.id, 0) + m.getNumTrees
    return np.mean([(total[k] / count[k] >= 0.5) == label[k] for k in count])


def test_growing_keeps_trees_and_scores_out_of_bag(rows):
    forest = forests.Forest(NAMES, "y", "id", depth=5).grow(rows, 6)
    first = [t.toDebugString for t in forest.batches[0].trees]
    forest.grow(rows, 4)
    assert forest.trees == 10 and [t.toDebugString for t in forest.batches[0].trees] == first
    assert forest.accuracy(rows) == pytest.approx(plain_accuracy(forest, rows))
    seen = rows.where(forest.bagged(0)).count() / 600
    assert abs(seen - forests.SHARE) < 0.06 and forest.accuracy(rows) > 0.75
    none = forest.out_of_bag(rows).where("p is null").count()
    assert none == rows.where(forest.bagged(0) & forest.bagged(1)).count()


def test_forest_stops_when_it_gains_nothing(rows):
    forest, scores = forests.grown(rows, NAMES, "y", "id", step=5, most=20, depth=4)
    assert forest.trees == 5 * len(scores) <= 20
    assert all(b - a >= 1e-3 for a, b in zip(scores[:-1], scores[1:-1], strict=False))
    assert len(scores) == 4 or scores[-1] - scores[-2] < 1e-3
    assert forest.scored(rows).where((F.col("pred") == 1) != (F.col("p") >= 0.5)).count() == 0


def test_halving_keeps_the_better_half_and_agrees_on_reruns(rows):
    run = lambda: forests.halving(rows, NAMES, "y", "id", least=2, most=8)
    table, best = run()
    got = table.collect()
    assert [sum(r.round == k for r in got) for k in range(3)] == [4, 2, 1] and {r.trees for r in got if r.round == 2} == {8}
    alive = {r.candidate for r in got if r.round == 0}
    for k in range(3):
        field = sorted((r for r in got if r.round == k), key=lambda r: (-r.oob, r.candidate))
        assert {r.candidate for r in field} == alive and all(r.trees == 2 * 2**k for r in field)
        alive = {r.candidate for r in field[: math.ceil(len(field) / 2)]}
        assert {r.candidate for r in field if r.survived} == alive
    last = [r for r in got if r.round == 2][0]
    assert best.trees == 8 and best.settings == {"depth": last.depth, "subset": last.subset, "split": last.split, "leaf": last.leaf}
    assert last.oob == pytest.approx(plain_accuracy(best, rows))
    assert sorted(run()[0].collect()) == sorted(got)


def test_candidates_differ():
    got = forests.candidates(50)
    assert len({tuple(c.items()) for c in got}) == 50 and forests.candidates(50) == got
    assert len(forests.candidates(10_000)) == 4 * 3 * 3 * 3
    assert list(forests._rounds(1, 50, 400, 2)) == [0] and list(forests._rounds(8, 50, 400, 2)) == [0, 1, 2, 3] and list(forests._rounds(30, 50, 100, 2)) == [0, 1]
