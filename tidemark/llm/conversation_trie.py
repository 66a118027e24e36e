"""A trie of conversations: every shared beginning once, with what hangs on it.

A prefix of a conversation has a digest: the exclusive or of a hash of each of its turns and that turn's place, so it is a running aggregate
and a long conversation is dealt over many tasks. A count-min sketch of all digests screens them: where its estimate is one, nobody else
has the prefix nor any longer one, and the tail is given out as it is. Only prefixes that may be shared are shuffled and counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parts import numbered, running
from .common import attach, count_words, written

#: Counters of one block of the sketch.
BLOCK = 1 << 16


class Sketch:
    """A count-min sketch of 64-bit digests whose counters stop at two: ``rows`` rows of 2^``bits`` counters."""

    def __init__(self, bits: int, rows: int = 3):
        self.bits, self.rows, self.cells = bits, rows, None
        self.times = np.random.default_rng(11).integers(0, 1 << 64, (rows, 1), np.uint64) | np.uint64(1)

    def places(self, digests: np.ndarray) -> np.ndarray:
        """The counter of each digest in each row (``rows`` by digests), counted over all rows."""
        x = digests.view(np.uint64) ^ (digests.view(np.uint64) >> np.uint64(32))
        at = (x * self.times) >> np.uint64(64 - self.bits)
        return at.astype(np.int64) + (np.arange(self.rows, dtype=np.int64) << self.bits)[:, None]

    def several(self, digests: np.ndarray) -> np.ndarray:
        """Whether the estimate of each digest is over one: the least of its counters, so it is never too low."""
        at = self.places(digests)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def screened(digests: DataFrame, column: str, most_bits: int = 26, rows: int = 3) -> Sketch:
    """The sketch of ``column`` over all rows: each task counts its own digests, and the tasks' counters are added block by block.

    There are four counters or more for each digest, up to 2^``most_bits`` a row (24 MB in all, which is what comes to the driver and is
    broadcast). Where the sketch is fuller, more prefixes pass as possibly shared; none is lost.
    """
    n, bits = digests.count(), 16
    while bits < most_bits and (1 << bits) < 4 * n:
        bits += 1
    sketch = Sketch(bits, rows)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks(parts: list[np.ndarray]) -> pd.DataFrame:
            cells, times = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.flatnonzero(np.diff(cells >> 16, prepend=-1))
            low, two = (cells & (BLOCK - 1)).astype("<u2"), times > 1
            ends = [*edges[1:].tolist(), len(cells)]
            rows = [(int(cells[a] >> 16), low[a:b].tobytes(), np.packbits(two[a:b]).tobytes()) for a, b in zip(edges.tolist(), ends, strict=True)]
            return pd.DataFrame(rows, columns=["block", "cells", "two"])

        held, size = [], 0
        for x in frames:
            held.append(sketch.places(x[column].to_numpy(np.int64)).ravel())
            size += len(held[-1])
            if size > 6_000_000:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)

    def added(x: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(BLOCK, np.uint8)
        for cells, two in zip(x.cells, x.two, strict=True):
            at = np.frombuffer(cells, "<u2")
            sums[at] = np.minimum(sums[at] + 1 + np.unpackbits(np.frombuffer(two, np.uint8), count=len(at)), 2)
        return pd.DataFrame({"block": x.block[:1], "several": [np.packbits(sums > 1, bitorder="little").tobytes()]})

    told = digests.select(column).mapInPandas(counted, "block long, cells binary, two binary")
    sketch.cells = np.zeros((rows << bits) >> 3, np.uint8)
    for r in told.groupBy("block").applyInPandas(added, "block long, several binary").collect():  # bounded by the sketch
        sketch.cells[r.block * BLOCK >> 3 : (r.block + 1) * BLOCK >> 3] = np.frombuffer(r.several, np.uint8)
    return sketch


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, n, t1, t2, words, _part``: the turns, numbered from 1 by ``turn`` (null first), as hashes of role and text. Turns of equal
    number go by the first hash. Rows without a ``conv_id`` belong to no conversation and are left out; null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (1, 2)]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *hashes, count_words(text).alias("words"))
    return written(numbered(rows, ["conv"], ["turn", "t1", "t2"]).drop("turn"), "turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` and conversations for :func:`trie`: each with its own turns."""
    convs = written(turns.groupBy("conv").agg(F.count("*").alias("len")), "convs")
    parts = turns.select("_part", "conv").distinct().join(convs, "conv")
    return turns.join(parts, ["_part", "conv"]).withColumnRenamed("n", "depth"), convs


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The same for rebuilt conversations: the first h turns of the conversation whose number is the last multiple of ``every`` (all if it has
    fewer, none if there is none), then the own turns after the first h; h is the number's CRC-32 modulo ``heads``."""
    counts = turns.groupBy("conv").agg(F.count("*").alias("own"))
    counts = written(counts.withColumns({"base": F.col("conv") - F.col("conv") % every, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads}), "counts")
    taken = F.least("h", F.coalesce("first", F.lit(0)))
    info = counts.join(counts.select(F.col("conv").alias("base"), F.col("own").alias("first")), "base", "left")
    info = written(info.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    parts = turns.select("_part", "conv").distinct().join(info, "conv")  # as many rows for a conversation as parts
    own = turns.join(parts, ["_part", "conv"]).where("n > h").withColumn("depth", F.col("n") - F.col("h") + F.col("taken"))
    first = turns.where((F.col("n") < heads) & (F.col("conv") % every == 0)).drop("_part").withColumnRenamed("conv", "base")
    first = first.join(info, "base").where("n <= h").withColumns({"depth": F.col("n"), "_part": F.lit(-1)})  # before all parts
    columns = ["_part", "conv", "depth", "len", "t1", "t2", "words"]
    return own.select(columns).unionByName(first.select(columns)), info.select("conv", "len")


def digests_of_ends(ends: DataFrame, room: int = 12) -> DataFrame:
    """``k, ends_sha256`` from ``k, conv``: the SHA-256 of a node's conversations, as decimal numbers in ascending order with commas.

    Conversations are joined in stretches of 2^``room`` numbers. Nodes of one stretch are digested at once; of others the stretches go
    in order through one digest, a batch of them in memory at a time.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    stretches = written(ends.groupBy("k", F.shiftright("conv", room).alias("at")).agg(joined.alias("ids")), "stretches")
    nodes = stretches.groupBy("k").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    one = nodes.where("n = 1").select("k", F.sha2("ids", 256).alias("ends_sha256"))
    more = stretches.join(nodes.where("n > 1").select("k"), "k", "left_semi").select("k.k1", "k.k2", "at", "ids")

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for x in frames:
            for k1, k2, ids in zip(x.k1, x.k2, x.ids, strict=True):
                if now == (k1, k2):
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield pd.DataFrame([(*now, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])
                now, digest = (k1, k2), hashlib.sha256(ids.encode())
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    in_order = more.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at")
    return one.unionByName(in_order.mapInPandas(streamed, "k1 long, k2 long, ends_sha256 string").select(F.struct("k1", "k2").alias("k"), "ends_sha256"))


def _marked(turns: DataFrame, **sketch) -> DataFrame:
    """``turns`` with ``k``, the digest of the prefix that ends with each, ``pk``, that of the one before, and whether these may be shared; written."""
    e = {f"e{i}": F.xxhash64("depth", f"t{i}") for i in (1, 2)}
    hashed = written(turns.select("_part", "conv", "depth", "len", "words", *[c.alias(name) for name, c in e.items()]), "hashed")
    rows = running(hashed, ["conv"], ["depth"], k1=("xor", F.col("e1")), k2=("xor", F.col("e2")))
    before = [F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"k{i}") for i in (1, 2)]
    rows = written(rows.select("_part", "conv", "depth", "len", "words", F.struct("k1", "k2").alias("k"), F.struct(*before).alias("pk"), "k1"), "prefixes")
    told = rows.sparkSession.sparkContext.broadcast(screened(rows, "k1", **sketch))
    several = F.pandas_udf(lambda k: pd.Series(told.value.several(k.to_numpy(np.int64))), "boolean")
    below = F.when(F.col("depth") == 1, F.lit(True)).otherwise(several(F.col("pk.k1")))  # the root is everybody's
    return written(rows.select("*", several("k1").alias("shared"), below.alias("below")).drop("k1"), "marked")


def trie(turns: DataFrame, convs: DataFrame, **sketch) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each distinct prefix.

    ``turns``: ``_part, conv, depth, len, t1, t2, words`` as :func:`rebuilt` gives them; ``convs``: ``conv, len`` of all, those of no turns too.
    A node's subtree is summed over its members: each conversation adds what the nodes from there on that it represents (as their smallest
    member) are worth, a running sum from its end. So no list of members, children or turns is ever gathered. Without conversations there
    are no nodes.
    """
    rows = _marked(turns, **sketch)
    alone, none = rows.where("not shared"), F.lit(None).cast("struct<k1:bigint,k2:bigint>")
    top = F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    root = convs.select(F.lit(-1).alias("_part"), "conv", F.lit(0).cast("long").alias("depth"), "len", F.lit(0).cast("long").alias("words"), top.alias("k"), none.alias("pk"), F.lit(False).alias("below"))
    met = written(rows.where("shared").drop("shared").unionByName(root), "met")
    exact = met.groupBy("k").agg(F.count("*").alias("n"), F.min("conv").alias("rep"), F.max(F.col("depth") < F.col("len")).alias("inner"), F.first("depth").alias("depth"), F.first("pk").alias("pk"), F.first("below").alias("below"))
    exact = written(exact, "nodes")
    members = written(attach(met, exact.select("k", "n", "rep", "inner"), "k", "n"), "members")
    stands, ends = F.col("rep") == F.col("conv"), F.col("depth") == F.col("len")
    worth = members.select("_part", "conv", "depth", "k", F.when(stands, (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved"), F.when(stands & ends & ~F.col("inner"), 1).otherwise(0).cast("long").alias("leaf"))
    tails = alone.where(ends).select("_part", "conv", "depth", none.alias("k"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    summed = running(written(worth.unionByName(tails), "worth"), ["conv"], ["depth"], backwards=True, s=("sum", F.col("saved")), l=("sum", F.col("leaf")))
    summed = summed.where("k is not null").groupBy("k").agg(F.sum("s").alias("saved_tokens"), F.sum("l").alias("n_leaves"))
    hanging = exact.where("below").select("pk").unionByName(alone.where("below").select("pk"))  # one row for each node below one of these
    children = hanging.groupBy(F.col("pk").alias("k")).agg(F.count("*").alias("n_children"))
    nodes = exact.join(summed, "k").join(children, "k", "left").join(digests_of_ends(members.where(ends).select("k", "conv")), "k", "left")
    nodes = written(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))}), "summed")
    own = F.sha2(F.when(ends, F.col("conv").cast("string")).otherwise(""), 256)
    single = alone.select("pk", "below", F.col("conv").alias("rep"), "depth", F.lit(1).cast("long").alias("n"), (~ends).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), own.alias("ends_sha256"))
    result = lambda df, parent: df.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    local = result(single.where("not below").unionByName(nodes.where("not below").select(single.columns)), F.when(F.col("depth") > 0, F.col("rep")))
    asking = written(single.where("below").unionByName(nodes.where("below").select(single.columns)), "asking")
    parents = nodes.select(F.col("k").alias("pk"), F.col("rep").alias("parent"), F.col("n_children").alias("weight"))
    return local.unionByName(result(attach(asking, parents, "pk", "weight"), F.col("parent")))


def conversation_nodes(conversations: DataFrame, **sketch) -> DataFrame:
    """The trie of the conversations as they are. Null turns come first; null roles and texts are empty; rows without ``conv_id`` are left
    out; repeated rows are turns of their own; other columns are ignored; an empty table has no nodes."""
    return trie(*as_they_are(turns_of(conversations)), **sketch)


def rebuilt_nodes(conversations: DataFrame, **sketch) -> DataFrame:
    """The same of the rebuilt conversations (:func:`rebuilt`)."""
    return trie(*rebuilt(turns_of(conversations)), **sketch)
