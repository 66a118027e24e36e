"""Random forests that grow: trees are added to what is fitted, and rows outside a tree's bag score it. A halving search on top."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from contextlib import closing
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .models import assembled

#: What a bag holds of all rows: that of a bootstrap sample.
SHARE = 0.632
#: Values of the search. MLlib's trees have no smallest split: a node is cut where both parts keep half of it, or ``leaf`` if that is more.
CHOICES = {"depth": (5, 10, 20, 30), "subset": ("sqrt", "0.5", "log2"), "split": (2, 5, 10), "leaf": (1, 2, 4)}


class Forest:
    """A forest in batches of trees. Each batch is fitted on a bag of the rows, chosen by a hash of ``key`` (a column that tells rows apart),
    so every row knows which batches have not seen it, without a table of who was in which bag."""

    def __init__(self, features: Sequence[str], label: str, key: str, seed: int = 7, depth: int = 10, subset: str = "sqrt", split: int = 2, leaf: int = 1):
        self.features, self.label, self.key, self.seed = list(features), label, key, seed
        self.settings = {"depth": depth, "subset": subset, "split": split, "leaf": leaf}
        self.batches: list[RandomForestClassificationModel] = []

    @property
    def trees(self) -> int:
        return sum(m.getNumTrees for m in self.batches)

    def bagged(self, batch: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed), F.lit(batch)), F.lit(1000)) < int(SHARE * 1000)

    def grow(self, df: DataFrame, trees: int) -> Forest:
        """Adds ``trees`` trees, fitted on a new bag of ``df``; those that are there stay as they are."""
        n = len(self.batches)
        smallest = max(self.settings["leaf"], -(-self.settings["split"] // 2))
        rf = RandomForestClassifier(
            featuresCol="features", labelCol=self.label, numTrees=trees, maxDepth=self.settings["depth"], featureSubsetStrategy=self.settings["subset"],
            minInstancesPerNode=smallest, seed=self.seed + n, maxMemoryInMB=512,
        )
        self.batches.append(rf.fit(vectors(df, self.features).where(self.bagged(n))))
        return self

    def _summed(self, df: DataFrame, unseen: bool) -> DataFrame:
        """``df`` with ``_p`` and ``_t``: the probabilities of the trees that count (``unseen``: only those of other bags) and their number."""
        out = vectors(df, self.features).withColumns({"_p": F.lit(0.0), "_t": F.lit(0)})
        for i, m in enumerate(self.batches):
            here = ~self.bagged(i) if unseen else F.lit(True)
            one = m.copy().setPredictionCol("_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw").transform(out)
            p = F.when(here, vector_to_array("_prob")[1] * m.getNumTrees).otherwise(0.0)
            out = one.withColumns({"_p": F.col("_p") + p, "_t": F.col("_t") + F.when(here, m.getNumTrees).otherwise(0)}).drop("_pred", "_prob", "_raw")
        return out.drop("features")

    def scored(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` with ``p`` and ``pred``."""
        out = self._summed(df, False).withColumn("p", F.try_divide("_p", "_t")).drop("_p", "_t")
        return out.withColumn("pred", (F.col("p") >= threshold).cast("int"))

    def out_of_bag(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p`` by the trees that have not seen a row; null where all have."""
        return self._summed(df, True).withColumn("p", F.try_divide("_p", "_t")).drop("_p", "_t")

    def accuracy(self, df: DataFrame) -> float:
        """The share of right labels out of bag, in one pass over ``df``; 0 if every tree has seen every row."""
        hit = ((F.col("p") >= 0.5).cast("int") == F.col(self.label)).cast("double")
        return self.out_of_bag(df).where("p is not null").agg(F.coalesce(F.avg(hit), F.lit(0.0))).first()[0]


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df if "features" in df.columns else assembled(features).transform(df)


def grown(df: DataFrame, features: Sequence[str], label: str, key: str, step: int = 50, most: int = 400, least_gain: float = 1e-3, seed: int = 7, **settings) -> tuple[Forest, list[float]]:
    """A forest that grows by ``step`` trees until that raises its accuracy out of bag by less than ``least_gain``, or ``most`` are there; with the
    accuracy after each step."""
    forest, scores = Forest(features, label, key, seed, **settings), []
    rows = written(df, "forest")
    while forest.trees < most:
        scores.append(forest.grow(rows, min(step, most - forest.trees)).accuracy(rows))
        if len(scores) > 1 and scores[-1] - scores[-2] < least_gain:
            break
    return forest, scores


def candidates(n: int, choices: Mapping[str, Sequence] = CHOICES, seed: int = 7) -> list[dict]:
    """``n`` different settings at random; all of them, if there are fewer."""
    names = list(choices)
    total = 1
    for c in choices.values():
        total *= len(c)
    out = []
    for i in random.Random(seed).sample(range(total), min(n, total)):
        one = {}
        for name in names:
            i, at = divmod(i, len(choices[name]))
            one[name] = choices[name][at]
        out.append(one)
    return out


def halving(df: DataFrame, features: Sequence[str], label: str, key: str, least: int = 50, most: int = 400, factor: int = 2, choices: Mapping[str, Sequence] = CHOICES, n: int | None = None, seed: int = 7, side_by_side: int = 4) -> tuple[DataFrame, Forest]:
    """A tournament of forests with the number of trees as the resource: ``round, candidate, depth, subset, split, leaf, trees, oob, survived``
    for each round and candidate, and the forest that wins.

    ``n`` settings (``most // least`` by default) start with ``least`` trees; in each round the better half (one in ``factor``, rounded up) survives and
    its forests grow to ``factor`` times as many trees, up to ``most``, keeping those that they have. They are scored out of bag; of equal
    scores the earlier candidate survives. The last round has one candidate, or as many trees as are allowed. A seed gives the same rows
    again. Rows are read once into a table of vectors; ``side_by_side`` candidates are fitted at a time.
    """
    rows = written(assembled(features).transform(df.select(*features, label, key)), "search")
    field = [(i, Forest(features, label, key, seed, **s)) for i, s in enumerate(candidates(n or max(1, most // least), choices, seed))]
    out, trees = [], least
    with closing(ThreadPool(side_by_side)) as pool:

        def play(one: tuple[int, Forest]) -> float:
            _, forest = one
            if forest.trees < trees:
                forest.grow(rows, trees - forest.trees)
            return forest.accuracy(rows)

        for turn in _rounds(len(field), least, most, factor):
            trees = min(most, least * factor**turn)
            scores = pool.map(inheritable_thread_target(df.sparkSession)(play), field)
            order = sorted(range(len(field)), key=lambda i: (-scores[i], field[i][0]))
            stay = set(order[: -(-len(field) // factor)])
            out += [(turn, field[i][0], *(f"{v}" if k == "subset" else v for k, v in f.settings.items()), f.trees, scores[i], i in stay) for i, (_, f) in enumerate(field)]
            best = field[order[0]][1]
            field = [field[i] for i in sorted(stay)]
    schema = "round int, candidate int, depth int, subset string, split int, leaf int, trees int, oob double, survived boolean"
    return df.sparkSession.createDataFrame(out, schema), best


def _rounds(n: int, least: int, most: int, factor: int) -> Iterator[int]:
    """The numbers of the rounds: until one candidate has played, or ``most`` trees are reached."""
    turn = 0
    while True:
        yield turn
        if n <= 1 or least * factor**turn >= most:
            return
        n, turn = -(-n // factor), turn + 1
