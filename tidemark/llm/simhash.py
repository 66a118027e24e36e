"""SimHash near-deduplication through a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, id_back, id_text, one_of_each, written
from .components import components, rooted
from .near_copies import near_groups

#: Of the alternating bits 0, 2, 4, ...
EVEN = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3) -> int:
    """A text's fingerprint as a signed 64-bit integer; 0 without any word."""
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends, digest = ends[min(words, len(w)) - 1 :].tolist(), xxhash.xxh64_intdigest
    over = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=False)], "<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, f`` for each row of ``docs``; nothing but these two columns is passed on."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "f": np.array([fingerprint(t, words) for t in x.text], np.int64)})

    return id_back(id_text(docs, "text").mapInPandas(batches, "doc_id string, f long"))


def thermometer(f: Column) -> Column:
    """The embedding: 32 segments of two bits become their bit counts 0, 1, 2, written as 00, 01, 11.

    Bits that differ between two such words number the Manhattan distance of the bit counts, which is at most
    the number of bits that differ between the fingerprints themselves.
    """
    odd = F.shiftrightunsigned(f, 1)
    one, two = f.bitwiseOR(odd).bitwiseAND(F.lit(EVEN)), f.bitwiseAND(odd).bitwiseAND(F.lit(EVEN))
    return one.bitwiseOR(F.shiftleft(two, 1))


def cells(prints: DataFrame, width: int) -> DataFrame:
    """The six cells of each row (``f, rest, cell``): ``rest``, of ``width`` bits, in four bands, of which each pair makes a cell; the other two
    bands are the ``rest`` inside it. Where two values differ in two bits or fewer, two bands at least are equal."""
    n = width // 4
    band = [F.shiftrightunsigned("rest", n * i).bitwiseAND(F.lit((1 << n) - 1)) for i in range(4)]
    both = lambda i, j: F.shiftleft(band[i], n).bitwiseOR(band[j])
    pairs = list(combinations(range(4), 2))
    each = F.array(*[F.struct(F.xxhash64("cell", F.lit(k), both(i, j)).alias("cell"), both(*(x for x in range(4) if x not in (i, j))).alias("rest")) for k, (i, j) in enumerate(pairs)])
    return prints.select("f", F.explode(each).alias("x")).select("f", "x.cell", "x.rest")


def links(prints: DataFrame, bits: int = 2, room: int = 48) -> DataFrame:
    """Links ``a, b``: all pairs of distinct fingerprints (column ``f``) at ``bits`` (1 or 2) or fewer apart, each at least once.

    Grid over the bit counts of the segments: they make four bands, and where the Manhattan distance is 2 or less two bands at least
    are equal, so both fingerprints share one of the six cells that a pair of bands makes. In a cell of up to ``room`` fingerprints the pairs
    within the Manhattan distance are verified on the bits. A fuller cell is cut again by the bands of the counts that are still
    free in it, and when all but two of these are fixed, in the same way with segments of one bit, where the Manhattan distance
    is the number of differing bits; so in the end no cell holds more than four. A fingerprint has at most 2,080 others within
    two bits, so links grow with the number of fingerprints even where all of them are variants of one text.
    """
    if bits not in (1, 2):
        raise ValueError("bits is 1 or 2")
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    start = lambda rest: (lambda df: df.withColumn("rest", rest))
    todo, out = prints.select("f", F.lit(0).cast("long").alias("cell")), None
    grids = [(64, start(thermometer(F.col("f")))), (32, None), (16, None), (8, None), (64, start(F.col("f"))), (32, None), (16, None), (8, None), (4, None)]
    for i, (width, begin) in enumerate(grids):
        keyed = cells(begin(todo) if begin else todo, width)
        sizes = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(attach(written(keyed, "keyed"), sizes, "cell", "n"), "cells")
        last = i == len(grids) - 1
        near = (shared if last else shared.where(F.col("n") <= room)).groupBy("cell").agg(F.array_sort(F.collect_list("f")).alias("fs"))
        pairs = near.select("fs", F.explode("fs").alias("a")).select("a", F.explode(F.filter("fs", lambda x: x > F.col("a"))).alias("b"))
        pairs = pairs.where(differ(thermometer(F.col("a")), thermometer(F.col("b")))).where(differ(F.col("a"), F.col("b")))
        out = pairs if out is None else out.unionByName(pairs)
        todo = shared.where(F.col("n") > room).select("f", "cell", "rest")
        if last or todo.isEmpty():
            return out


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Documents at ``bits`` or fewer differing bits are linked; a component's id is its smallest ``doc_id`` (null
    only where no member has one). Null and wordless texts share the fingerprint zero and are linked like any other;
    shorter texts than ``words`` words are one shingle. Equal fingerprints meet once, whatever their number.
    """
    rows = written(fingerprints(docs, words), "prints")
    prints = written(rows.groupBy("f").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    known = rooted(prints, components(links(prints, bits)), F.min("first").alias("component_id"))
    out = attach(rows, known, "f", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group, that of the smallest ``doc_id`` (a null one last), with all columns; rows that repeat both ``doc_id``
    and text are one, and different texts under one ``doc_id`` are judged each by itself.

    Fingerprints are joined as in :func:`simhash_groups`, and what they link is verified by similarity; as at 0.8 most copies differ by more
    bits than fingerprints can be joined on, the groups are completed by ``near_copies``.
    """
    keep = near_groups(docs, words, similarity, fingerprint=fingerprint, linked=links).where("first").select("doc_id", "version").distinct()
    return one_of_each(docs, keep, F.xxhash64("text"))
