"""Near copies by the similarity of their sets of word shingles: candidates by MinHash bands, each verified exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import attach, id_back, id_text, written
from .components import components, met, rooted
from .substring_dedup import MIX, WordHashes, rolled

#: Two sets of similarity s share one of the 24 bands of 6 minima with probability 1 - (1 - s^6)^24: 0.9993 at 0.8, 0.9999 from 0.83.
BANDS, MINIMA = 24, 6
_RNG = np.random.default_rng(5)
FLIP = _RNG.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64)
TIMES = _RNG.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64) | np.uint64(1)
FOLD = _RNG.integers(0, 1 << 64, (BANDS, MINIMA), np.uint64) | np.uint64(1)


def shingles(text: str | None, hashes: WordHashes, words: int = 5) -> np.ndarray:
    """The hashes of a text's shingles, sorted, once each. A shorter text is one shingle; none without any word."""
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    return np.unique(rolled(a, min(words, len(w))))


def bands(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of a set of shingles, and the last eight bits of each minimum."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(grams), 4096):
        low = np.minimum(low, ((grams[i : i + 4096] ^ FLIP) * TIMES).min(axis=1))
    keys = (low.reshape(BANDS, MINIMA) * FOLD).sum(axis=1, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * MIX).view(np.int64), (low >> np.uint64(56)).astype(np.uint8).view(np.int8)


def digest(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 7) - (1 << 63)


def _sketches(docs: DataFrame, words: int, fingerprint: Callable[[str | None, int], int] | None = None) -> DataFrame:
    """``doc_id, version, f, print, size, bands, lows, grams`` for each row (``print``: its ``fingerprint``): the hash of its text, the digest of its set of shingles, their number, the band
    keys, eight bits of each minimum and the set itself."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for x in frames:
            g = [shingles(t, hashes, words) for t in x.text]
            keys = [bands(s) for s in g]
            out = {"f": np.array([digest(s) for s in g], np.int64), "print": np.array([fingerprint(t, words) if fingerprint else 0 for t in x.text], np.int64), "size": np.array([len(s) for s in g], np.int64), "bands": [k for k, _ in keys], "lows": [b for _, b in keys], "grams": [s.view(np.int64) for s in g]}
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "version": x.version.to_numpy()} | out)

    keyed = id_text(docs, F.xxhash64("text").alias("version"), "text")
    return id_back(keyed.mapInPandas(batches, "doc_id string, version long, f long, print long, size long, bands array<long>, lows array<tinyint>, grams array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Pairs of which too few minima are equal go first: as many as a pair of that similarity has, less six deviations, so that one in a
    thousand million of these is lost. Then only the sets of the others are shuffled: a filter of 2^19 numbers at most, whatever the
    input, spares most sets that.
    """
    with scratch(sets.sparkSession) as scope:
        return scope.keep(_similar(pairs, sets, rows, similarity), "near")


def _similar(pairs: DataFrame, sets: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    n = BANDS * MINIMA
    lows = sets.select("f", "lows")
    both = pairs.distinct().join(lows.select(F.col("f").alias("a"), F.col("lows").alias("x")), "a").join(lows.select(F.col("f").alias("b"), F.col("lows").alias("y")), "b")
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    pairs = written(both.where(equal >= n * similarity - 6 * np.sqrt(n * similarity * (1 - similarity))).select("a", "b"), "candidates")
    asked = pairs.select(F.col("b").alias("f"), F.lit(1).alias("n")).unionByName(pairs.select(F.col("a").alias("f"), F.lit(0).alias("n"))).groupBy("f").agg(F.sum("n").alias("n"))
    bucket = F.pmod("f", F.lit(1 << 19))
    some = F.broadcast(asked.select(bucket.alias("_bucket")).distinct())
    grams = rows.select("f", "grams").withColumn("_bucket", bucket).join(some, "_bucket", "left_semi").drop("_bucket").dropDuplicates(["f"])
    grams = written(grams.join(asked, "f"), "shingles")
    right = grams.select(F.col("f").alias("b"), F.col("grams").alias("other"), "n")
    sides = attach(pairs, right, "b", "n").join(grams.select(F.col("f").alias("a"), "grams"), "a")
    both = F.size(F.array_intersect("grams", "other"))
    return sides.where(both / (F.size("grams") + F.size("other") - both) >= similarity).select("a", "b")


def _linked(edges: DataFrame, few: int = 1 << 18) -> DataFrame:
    """The components of ``edges``, as a table. Up to ``few`` links are followed in the driver, which takes some megabytes, whatever the input: rounds
    over all partitions would write far more than that."""
    spark = edges.sparkSession
    with scratch(spark) as scope:
        links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if links.count() > few:
            return scope.keep(components(links), "roots")
        table = links.toArrow()
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = spark.createDataFrame(pa.table({"node": nodes, "root": nodes[_least(len(nodes), *np.split(at, 2))]}), "node long, root long")
        return scope.keep(roots, "roots")


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that each can reach by the links ``a, b``."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _rarest(last: DataFrame, rows: DataFrame, similarity: float, room: int) -> DataFrame:
    """``f, size, y``: the sets of full cells with those (``y``: ``f, size, root``) of other components that may be similar.

    Shingles are ordered alike in all sets: first those of one component only, which no link between components needs, then the rarest, counted
    over these sets. Two sets of that similarity, of ``a`` and ``b`` shingles, have a share ``s / (1 + s)`` of ``a + b`` in common; so the first one in common stands
    no later in either than what that leaves. How much this is depends on the other's size: a set is entered under a shingle once
    for each class of sizes, two in the hundred wide, that occurs with it and lets it stand there. Where one component alone is entered, nothing
    meets; else each set that is not of the most frequent component meets the others. So variants of one text that are not similar to it
    do not meet those that are, and the latter never meet each other. Up to ``room`` entries meet in place, more by a join that can be split.
    Nothing is lost.
    """
    with scratch(last.sparkSession) as scope:
        return scope.keep(_entered(last, rows, similarity, room), "far")


def _entered(last: DataFrame, rows: DataFrame, similarity: float, room: int) -> DataFrame:
    share, eps = similarity / (1 + similarity), 1e-6
    sets = written(last.select("f", "size", "root").distinct().withColumn("class", F.floor(F.log("size") / np.log(1.02))), "left")
    grams = rows.select("f", "grams").join(sets, "f").dropDuplicates(["f"]).select(*sets.columns, F.explode("grams").alias("gram"))
    grams = written(grams, "grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("gram", "n")
    own = Window.partitionBy("f")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "gram"))
    first = met(grams, counts, "gram").withColumn("at", at).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - eps) + 1)
    first = written(first.select("gram", "f", "size", "root", "class", "at"), "rarest")
    others = first.groupBy("gram", "class").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    others = others.groupBy("gram").agg(F.collect_list(F.struct("class", "least", "most", "low", "high")).alias("others"), (F.min("low") < F.max("high")).alias("mixed")).where("mixed").drop("mixed")
    common = lambda a, b: F.ceil((a + b) * share - eps)
    fit = lambda o: (o.least * similarity <= F.col("size") + eps) & (o.most + eps >= F.col("size") * similarity) & ((o.low != F.col("root")) | (o.high != F.col("root")))
    stands = lambda o: F.col("at") <= F.col("size") - common(F.col("size"), F.greatest(o.least, F.col("size") * similarity)) + 1
    other = F.explode(F.transform(F.filter("others", lambda o: fit(o) & stands(o)), lambda o: o["class"])).alias("other")
    entered = met(first, others, "gram").select("gram", "f", "size", "root", "class", "at", other)
    entered = written(entered.withColumn("place", F.xxhash64("gram", F.least("class", "other"), F.greatest("class", "other"))), "entered")
    mains = entered.groupBy("place", "root").agg(F.count("*").alias("n"))
    mains = mains.groupBy("place").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    entered = written(met(entered, mains, "place"), "places").withColumn("x", F.struct("f", "size", "root", "class", "other", "at"))

    def near(x: Column, y: Column) -> Column:
        t = common(x.size, y.size)
        return (x.root != y.root) & (x["class"] == y.other) & (x.other == y["class"]) & (x["at"] <= x.size - t + 1) & (y["at"] <= y.size - t + 1)

    small = entered.where(F.col("n") <= room).groupBy("place").agg(F.first("main").alias("main"), F.collect_list("x").alias("ys"))
    small = small.select("ys", F.explode(F.filter("ys", lambda y: y.root != F.col("main"))).alias("x"))
    small = small.select("x", F.explode(F.filter("ys", lambda y: near(F.col("x"), y))).alias("y"))
    more = entered.where(F.col("n") > room)
    far = more.where("x.root <> main").select("place", "x").join(more.select("place", F.col("x").alias("y")), "place").where(near(F.col("x"), F.col("y")))
    return small.unionByName(far.select("x", "y")).select("x.f", "x.size", F.struct("y.f", "y.size", "y.root").alias("y")).distinct()


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, room: int = 48, depth: int = 4, fingerprint: Callable[[str | None, int], int] | None = None, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id, version, component_id, first`` for each row of ``docs``: documents whose sets of shingles of ``words`` words have a Jaccard
    similarity of ``similarity`` or more are linked, and a component's id is its smallest ``doc_id`` (null only where no member has
    one). ``version`` is the text's hash; ``first`` marks the rows that are the component's first by ``doc_id`` and version. Wordless texts
    are equal.

    With a ``fingerprint``, sets of equal ones, and those that ``linked`` (``a, b`` of a table of ``f``) gives, are verified first. Then sets that
    share a band key are candidates, where their sizes allow the similarity. Equal sets meet once. In each band all sets are verified against one
    of them, which leaves the band; so variants of one text never make all their pairs. The first is the set that shares bands with the most others,
    as the middle of many variants does. This is done ``depth`` times, with the bands that still hold several components. Of what is left
    then all pairs of a band of up to ``room`` sets are verified, and the sets of a fuller one meet by their rarest shingles (:func:`_rarest`),
    where they are of different components. The sets of shingles are written once, and removed when the groups are known.
    """
    with scratch(docs.sparkSession) as scope:
        rows = written(_sketches(docs, words, fingerprint), "sketches")
        at = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "version")
        sets = written(rows.groupBy("f").agg(F.min(at).alias("first"), F.count("*").alias("n"), F.min("print").alias("print"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("lows").alias("lows")), "sets")
        links = _fingerprinted(sets, rows, similarity, linked) if fingerprint and linked else None
        known = rooted(sets.select("f", "first", "n"), _roots(sets, rows, similarity, room, depth, links), F.min("first").alias("component"))
        out = attach(rows.select("doc_id", "version", "f"), known.select("f", "n", "component"), "f", "n")
        first = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("version") == F.col("component.version"))
        return scope.keep(out.select("doc_id", "version", F.col("component.doc_id").alias("component_id"), first.alias("first")), "near_groups")


def _fits(similarity: float) -> Column:
    return (F.col("f") != F.col("g")) & (F.least("size", "size_b") >= similarity * F.greatest("size", "size_b"))


def _fingerprinted(sets: DataFrame, rows: DataFrame, similarity: float, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` of sets: each with the first of its fingerprint, and the first ones of linked fingerprints, where they are similar."""
    with scratch(sets.sparkSession) as scope:
        return scope.keep(_prints_met(sets, rows, similarity, linked), "links")


def _prints_met(sets: DataFrame, rows: DataFrame, similarity: float, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    one = F.min_by(F.struct("f", "size"), "f").alias("one")
    prints = written(sets.groupBy("print").agg(one, F.count("*").alias("n")), "prints")
    own = attach(sets.select("f", "size", "print"), prints, "print", "n").select("f", "size", F.col("one.f").alias("g"), F.col("one.size").alias("size_b"))
    first = prints.select("print", "one")
    near = linked(prints.select(F.col("print").alias("f"))).join(first.select(F.col("print").alias("a"), F.col("one").alias("x")), "a").join(first.select(F.col("print").alias("b"), F.col("one").alias("y")), "b")
    near = near.select(F.col("x.f").alias("f"), F.col("x.size").alias("size"), F.col("y.f").alias("g"), F.col("y.size").alias("size_b"))
    return _verified(own.unionByName(near).where(_fits(similarity)).select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")), sets, rows, similarity)


def _roots(sets: DataFrame, rows: DataFrame, similarity: float, room: int, depth: int, links: DataFrame | None = None) -> DataFrame:
    """``node, root`` of the sets that are linked; ``links``: those that are known."""
    spark = sets.sparkSession
    cells, roots = sets.select("f", "size", F.explode("bands").alias("cell")), _linked(links) if links is not None else None
    with scratch(spark) as scope:
        cells = written(cells.join(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell"), "banded")
        cells = scope.keep(cells.drop("n").join(cells.groupBy("f").agg(F.sum("n").alias("weight")), "f"), "weighed")
    mixed = F.min("root") < F.max("root")  # without links each set is its own
    for level in range(depth + 1):
        with scratch(spark) as scope:
            if roots is not None:
                links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # the same components, one link to a node
            if level:
                cells = cells.join(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cell", "left_semi")
            cells = cells.withColumn("root", F.col("f")) if roots is None else cells.join(roots, F.col("f") == F.col("node"), "left").select("cell", "f", "size", "weight", F.coalesce("root", "f").alias("root"))
            cells = written(cells, "shared")
            pivot = F.min_by(F.struct("f", "size", "root"), F.xxhash64("f", F.lit(level)) if level else F.struct(-F.col("weight"), "f"))
            sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), mixed.alias("mixed"), pivot.alias("pivot")).where("mixed").drop("mixed")
            cells = scope.keep(met(cells, sizes, "cell"), "cells")
            if level < depth:
                pairs = cells.where("root <> pivot.root").select("f", "size", F.col("pivot").alias("y"))
            else:
                small = cells.where(F.col("n") <= room).groupBy("cell").agg(F.collect_list(F.struct("f", "size", "root")).alias("fs"))
                small = small.select("fs", F.explode("fs").alias("x")).select("x.*", F.explode(F.filter("fs", lambda y: (y.f > F.col("x.f")) & (y.root != F.col("x.root")))).alias("y"))
                pairs, last = small.select("f", "size", "y"), cells.where(F.col("n") > room)
                if not last.isEmpty():  # what shares bands and is not similar
                    pairs = pairs.unionByName(_rarest(last, rows, similarity, room).select("f", "size", "y"))
            pairs = pairs.select("f", "size", F.col("y.f").alias("g"), F.col("y.size").alias("size_b")).where(_fits(similarity))
            found = _verified(pairs.select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")), sets, rows, similarity)
            roots = scope.keep(_linked(found if links is None else links.unionByName(found)), "roots")
        if level == depth or cells.isEmpty():
            return roots
        cells = cells.where("f <> pivot.f").select("cell", "f", "size", "weight")
