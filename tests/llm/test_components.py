import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, near_copies
from tidemark.sources.shared import written


def test_links_of_one_root_are_split(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        links = written(spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 5_000).alias("u"), (F.col("id") + 10_000).alias("v")), "links")
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = components.met(links, low).select(F.sum(F.col("v") - F.col("m")))
        total = joined.collect()[0][0]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and total > 0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v else spark.conf.unset(n)


def sets_of(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute(texts):
    sets, root = {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("room", [2, 48])
def test_last_level_meets_by_rarest_shingles(spark, room):
    """Texts that share two thirds of their words, some of them near copies of others: cells overflow at once, and the last level is the first."""
    r = random.Random(6)
    common, texts = [f"w{i}" for i in range(120)], {}
    for i in range(60):
        own = [f"x{r.randrange(10_000)}" for _ in range(40)]
        texts[2 * i] = " ".join(common + own)
        texts[2 * i + 1] = " ".join(common + own[: r.choice([25, 30, 38, 40])] + [f"y{i}"])
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.near_groups(docs, room=room, depth=0).collect()}
    assert got == brute(texts)


def test_boilerplate_does_not_make_pairs_meet(spark):
    """2,000 texts of which five in six words are the same and no two similar: the rarest shingles leave few pairs."""
    rng = np.random.default_rng(1)
    common = np.arange(1_000, 1_500)
    sets = [(i, i, np.concatenate([common, 10_000 + 150 * i + np.arange(150)]).tolist()) for i in range(2_000)]  # similarity 500 / 800
    rows = spark.createDataFrame([(f, g) for f, _, g in sets], "f long, grams array<long>")
    last = spark.createDataFrame([(int(rng.integers(5)), f, len(g), root) for f, root, g in sets], "cell long, f long, size long, root long")
    assert near_copies._rarest(last, rows, 0.8, 48).count() == 0
