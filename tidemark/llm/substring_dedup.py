"""Removal of passages that occur earlier in the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_back, id_text, written

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """A word's 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 20)
        return out


def rolled(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` of the hashes ``a``, by doubling."""
    out, have, part, size, i = None, 0, a, 1, n
    with np.errstate(over="ignore"):
        while i:
            if i & 1:
                if out is None:
                    out, have = part, size
                else:
                    m = len(a) - have - size + 1
                    out, have = out[:m] * _power(size) + part[have : have + m], have + size
            i >>= 1
            if i:
                m = len(part) - size
                part, size = part[:m] * _power(size) + part[size : size + m], size * 2
        out = out ^ (out >> np.uint64(29))
        out = out * MIX
        return out ^ (out >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(MIX), n, 1 << 64))


def anchored(text: str | None, hashes: WordHashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of ``window`` words: its hash and the place of its anchor, the ``gram`` words in it of least hash (the first of
    equals); and the hashes of all grams. Equal windows have equal anchors."""
    words = (text or "").encode().split()
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams, span = rolled(a, gram), window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = np.concatenate([view[i : i + 100_000].argmin(axis=1) for i in range(0, len(view), 100_000)]) + np.arange(len(view))
    return rolled(a, window), at, grams


class Once:
    """Tells the first of the rows that repeat an id and a text within a task; it forgets what came before ``most`` of them."""

    def __init__(self, most: int = 500_000):
        self.most, self.seen = most, set()

    def new(self, keys: Iterable[int], versions: Iterable[int]) -> list[bool]:
        out = []
        for pair in zip(keys, versions, strict=True):
            out.append(pair not in self.seen)
            self.seen.add(pair)
        if len(self.seen) > self.most:
            self.seen.clear()
        return out


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(2**63 - 1))


def earlier_windows(docs: DataFrame, window: int = 20, gram: int = 8, most_bits: int = 1 << 28) -> DataFrame:
    """``key, version, starts``: for each text the places of the windows that start earlier in the corpus.

    Three steps, none of which shuffles a text. (1) Each document gives the hashes of its anchors, of which there is one
    for about seven windows; they are counted. (2) Those that occur more than once set a bit of a filter, the only thing that
    is broadcast: ``most_bits`` at most, whatever the corpus. Where it fills up, more windows pass it, never fewer.
    (3) Windows whose anchor passes go, in runs with the same anchor, to the partition of that anchor, where the earliest
    window of each hash is found. Windows of frequent anchors instead find it by partial minima and a join that
    can be split, so that no task holds all copies of a passage. Windows are equal when both hashes of 64 bits are, the anchor's
    and their own; as only windows of one anchor are ever compared, chance matches stay near none at any size.
    """

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, once = WordHashes(), Once()
        for x in frames:
            texts = x.text[once.new(x.key, x.version)]
            found = [grams[np.unique(at)].view(np.int64) for _, at, grams in (anchored(t, hashes, window, gram) for t in texts)]
            yield pd.DataFrame({"grams": pd.Series(found, dtype=object)})  # of a batch without any new row, pandas would make floats

    spark = docs.sparkSession
    keyed = docs.select(_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("version"), "text")
    found = keyed.mapInPandas(anchors, "grams array<long>").select(F.explode("grams").alias("gram"))
    often = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    total, some = often.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = 1 << 16
    while bits < min(most_bits, 16 * some):
        bits *= 2
    place = F.shiftrightunsigned("gram", 64 - (bits.bit_length() - 1))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    lanes = often.withColumn("place", place).groupBy(F.shiftright("place", 6).alias("i")).agg(F.bit_or(one).alias("bits"))
    lanes = lanes.toPandas()
    filled = np.zeros(bits // 64, np.uint64)
    filled[lanes.i.to_numpy(np.int64)] = lanes.bits.to_numpy(np.int64).view(np.uint64)
    shared, shift = spark.sparkContext.broadcast(filled), np.uint64(64 - (bits.bit_length() - 1))

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, once, known = WordHashes(), Once(), shared.value
        for x in frames:
            out, x = [], x[once.new(x.key, x.version)]
            for key, version, text in zip(x.key, x.version, x.text, strict=True):
                h, at, grams = anchored(text, hashes, window, gram)
                if not len(h):
                    continue
                p = grams[at] >> shift
                pass_ = (known[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (pass_[1:] != pass_[:-1])))
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(h))
                for i, j in zip(starts[pass_[starts]].tolist(), ends[pass_[starts]].tolist(), strict=True):
                    out.append((grams[at[i]].view(np.int64), key, version, i, h[i:j].view(np.int64)))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["gram", "key", "version", "start", "hashes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["gram", "key", "version", "start", "hashes"])

    passed = keyed.mapInPandas(runs, "gram long, key long, version long, start int, hashes array<long>")
    parts = max(500, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = often.where(F.col("n") > max(1000, total // parts)).select("gram", F.lit(True).alias("hot"))  # fewer than ``parts`` of them
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "version"), F.lit(64))).otherwise(F.lit(-1))
    dealt = passed.join(F.broadcast(frequent), "gram", "left").withColumn("salt", salt).repartition("gram", "salt")
    each = dealt.select("gram", "salt", "key", "version", "start", F.posexplode("hashes").alias("i", "hash"))
    place = F.struct("key", (F.col("start") + F.col("i")).alias("start"))
    each = each.select("gram", "salt", "version", "hash", place.alias("place"))
    each = each.withColumn("least", F.min("place").over(Window.partitionBy("gram", "salt", "hash")))
    first = F.col("place") == F.col("least")
    # of a frequent anchor, the first window in each part still has to be compared with those of other parts
    each = each.where(~first | (F.col("salt") >= 0)).select("gram", "place.key", "version", "place.start", F.when(first, F.col("hash")).alias("hash"))
    each = written(each, "windows")
    firsts = each.where("hash is not null")
    least = firsts.groupBy("gram", "hash").agg(F.min(F.struct("key", "start")).alias("least"))
    firsts = firsts.join(least, ["gram", "hash"]).where(F.struct("key", "start") > F.col("least"))
    late = each.where("hash is null").drop("gram", "hash").unionByName(firsts.select("key", "version", "start"))
    # rows that repeat an id and a text are one here: each task passes them once, and of several tasks their places are a set
    return written(late.groupBy("key", "version").agg(F.collect_set("start").alias("starts")), "late")


def remove_repeats(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row: the words left when each one covered by a window of ``window``
    consecutive words that also starts earlier (in a smaller ``doc_id``, or earlier in the same document) is removed.

    Windows are judged on the input. Words are split at ASCII white space and joined again by one space. A null text
    has no words; a null ``doc_id`` counts as the largest. Rows that repeat a ``doc_id`` are one place: none is
    earlier than the other. Texts of fewer words than a window stay whole.
    """

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for text, starts in zip(x.text, x.starts, strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                if starts is not None and len(words):
                    np.add.at(gone, starts, 1)
                    np.subtract.at(gone, np.asarray(starts) + window, 1)
                stay = np.cumsum(gone[:-1]) == 0
                out.append((len(words), int((~stay).sum()), b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k]).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"]).assign(doc_id=x.doc_id.to_numpy(object))[["doc_id", "n_words", "n_removed", "kept"]]

    keyed = docs.select("doc_id", "text", _key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("version"))
    found = keyed.join(earlier_windows(docs, window, **options), ["key", "version"], "left")
    return id_back(id_text(found, "text", "starts").mapInPandas(strip, "doc_id string, n_words long, n_removed long, kept string"))


def repeats_removed(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
