"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, written


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``key, source_size, target`` for each row of ``sizes`` (``key`` a sortable struct, ``source_size``).

    ``share`` times all sizes is split by weight; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight until none is above. That is a water level: with sources ordered by
    the level at which they are full, the first one that the remaining budget does not fill gives the level.
    One row per source meets here, no documents.
    """
    every = Window.partitionBy(F.lit(0))
    by_key, by_full = every.orderBy("key"), every.orderBy("full", "key")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_key) - 1) % n + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("full", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min_by(F.col("level"), F.when(F.col("level") <= F.col("full"), F.struct("full", "key"))).over(every)
    return t.withColumn("first", first).select("key", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("first"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, parts: int | None = None, row: str | None = None) -> DataFrame:
    """One row per document, ``key, id, row, size, source_size, target, copies``: how often the mix takes each; ``row``: a column that is passed on.

    Systematic sampling: within a source every document expects ``target / source_size`` copies; with the prefix
    sum of these and one offset per source, a document is emitted once per integer that its interval crosses. Documents
    are ordered by size class, so that the words taken follow the target closely. The prefix sum has two levels
    (``parts`` hashed parts of each size class, by default 64, and for over 64 million documents one for each million; then rows
    within a part), so no task holds a source.
    Offsets and order come from md5 of ``seed``, source and ``doc_id``: reruns agree. Null texts have size 0 and
    are taken as their source asks, at no words; a null source is a source of its own, last in order; rows that
    repeat a ``doc_id`` are numbered in turn. An empty table gives an empty result.
    """
    base = docs.select(
        F.struct(F.col("source").isNull().alias("z"), F.coalesce(F.col("source"), F.lit("")).alias("s")).alias("key"),
        F.col("doc_id").alias("id"),
        (F.col(row) if row else F.lit(None).cast("long")).alias("row"),
        count_words(F.col("text")).alias("size"),
    )
    base = written(base, "sizes")
    return _mixed(base, weights, share, most, seed, parts or max(64, base.count() // 1_000_000))


def _mixed(base: DataFrame, weights, share, most, seed, parts) -> DataFrame:
    base = base.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    base = base.withColumn("class", F.expr("16 * length(bin(size)) + shiftright(size, greatest(length(bin(size)) - 4, 0))")).withColumn("part", (F.conv(F.substring("order", 1, 4), 16, 10).cast("int") % parts if parts <= 4096 else F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % parts))
    cells = base.groupBy("key", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    cells = written(cells, "cells")
    targets = source_targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("key").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(targets, "key").drop("n", "words")
    within = Window.partitionBy("key", "class", "part").orderBy("size", "order", "id", "row")
    rows = base.withColumn("rank", F.row_number().over(within)).join(cells, ["key", "class", "part"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key.s"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    each = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(most)))
    upto = F.col("ahead") + F.col("rank")
    rows = rows.withColumn("copies", (F.floor(each * upto + offset) - F.floor(each * (upto - 1) + offset)).cast("long"))
    return rows.select("key", "id", "row", "size", "source_size", "target", "copies")


def mix_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``."""
    out = mix(docs, **options)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns. Rows are numbered and written first, so that
    those that share a ``doc_id``, or have none, each take their own number of copies."""
    rows = written(docs.withColumn("_tm_row", F.monotonically_increasing_id()), "rows")
    copies = mix(rows, row="_tm_row", **options).where("copies > 0").select(F.col("row").alias("_tm_row"), F.col("copies").cast("int").alias("_tm_copies"))
    joined = rows.join(copies, "_tm_row")
    return joined.select(*[f"`{c}`" for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("_tm_copies"))).alias("_tm_i")).drop("_tm_i")
