"""Connected components of a graph of links, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a``, ``b``, of one integer type); root: the smallest node reachable.

    Every round makes each node's larger neighbours, then its smaller ones, hang on its smallest neighbour, and
    is written to the shared folder. The number of rounds grows with the logarithm of the longest path. Only
    minima are grouped; no neighbour list is ever collected. The links of a node with very many (the root of a large component)
    meet its one minimum in a join that adaptive execution splits (:func:`met`). Self links and repeated links are allowed.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(met(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, low).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        links = written(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def met(links: DataFrame, low: DataFrame, key: str = "u") -> DataFrame:
    """``links``, read from a written table, joined with ``low``, one row for each ``key``. ``low`` is written first: adaptive execution splits the
    links of one key only where both sides come out of a shuffle of their own, and an aggregate is no such side."""
    return links.join(written(low, "low"), key)


def rooted(nodes: DataFrame, roots: DataFrame, *aggs: Column) -> DataFrame:
    """``nodes`` (one row for each ``f``) with ``root`` and the aggregates ``aggs`` over its component; one without links is its own."""
    known = written(nodes.join(roots, nodes.f == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "f")), "rooted")
    least = known.groupBy("root").agg(*aggs, F.count("*").alias("_n"))
    return written(attach(known, least, "root", "_n").drop("_n"), "known")
