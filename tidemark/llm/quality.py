"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of the bytes of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import running_sums
from .common import attach, id_back, id_text, written

#: Bits of a symbol in a packed n-gram; up to seven fit into a long.
BITS = 8
ORDER = 5


def symbols(text: str | None) -> np.ndarray:
    """The UTF-8 bytes of a text in lower case, white space as one, with starts in front. Every script has its own, and since there are 256, no
    context has more followers and no n-gram more predecessors, so the joins of the model have no hot keys."""
    return np.frombuffer(("\x01" * (ORDER - 1) + " ".join((text or "").lower().split())).encode(), np.uint8).astype(np.int64)


def packed(a: np.ndarray, n: int) -> np.ndarray:
    """All n-grams that end at a character of the text itself."""
    m, out = len(a) - ORDER + 1, 0
    for i in range(ORDER - n, ORDER):
        out = (out << BITS) | a[i : i + m]
    return out


def gram_counts(trusted: DataFrame) -> DataFrame:
    """``lang, gram, n``: counts of the longest n-grams over all of ``trusted`` (``lang``, ``text``); summed in each task first."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for lang, texts in x.groupby("lang").text:
                parts = [packed(symbols(t), ORDER) for t in texts]
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    return trusted.select("lang", "text").mapInPandas(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """``lang, k, gram, p, back``: of each n-gram of each order its log-probability and, for one that is a context, the log weight of
    the shorter context when what follows is new.

    Counts meet by joins on hashed n-grams and contexts. The highest order has counts of occurrences, each other one counts
    of different predecessors. Discounts for one, two, and three or more come from the counts of counts by language.
    """
    levels, out = {ORDER: counts}, None
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count("*").alias("n")), f"level{k}")
    below = levels[1].groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("lower"))
    contexts = {}
    for k in range(1, ORDER + 1):
        level = levels[k]
        of = lambda i: F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double")
        d = level.groupBy("lang").agg(*[of(i).alias(f"n{i}") for i in range(1, 5)])
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        cut = lambda i: F.least(F.greatest(F.coalesce(i - (i + 1) * F.col("y") * F.try_divide(f"n{i + 1}", F.col(f"n{i}")), F.lit(0.5 * i)), F.lit(0.05)), F.lit(i - 0.05))
        d = F.broadcast(d.withColumn("y", y).select("lang", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3")))  # one row for each language
        level = level.join(d, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        level = level.withColumn("context", F.shiftright("gram", BITS)).withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1))
        contexts[k] = written(level.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight")), f"contexts{k}")
        level = level.join(contexts[k], ["lang", "context"])
        level = level.join(F.broadcast(below), "lang") if k == 1 else level.join(below.withColumnRenamed("gram", "suffix"), ["lang", "suffix"])
        below = written(level.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("lower")).alias("lower")), f"order{k}")
        if k < ORDER:
            levels[k] = below
        row = below.select("lang", F.lit(k).alias("k"), "gram", F.ln("lower").alias("p"))
        out = row if out is None else out.unionByName(row)
    back = None
    for k in range(1, ORDER + 1):
        row = contexts[k].select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("gram"), F.ln("weight").alias("back"))
        back = row if back is None else back.unionByName(row)
    return out.join(back, ["lang", "k", "gram"], "full")


@dataclass
class KneserNey:
    """``tables``: by language and order, sorted n-grams with their log-probabilities and back-off weights; ``unseen``: the floor."""

    tables: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]
    unseen: dict[str, float]

    def log_p(self, a: np.ndarray, lang: str) -> np.ndarray:
        tables, n = self.tables[lang], max(0, len(a) - ORDER + 1)
        total, todo = np.zeros(n), np.arange(n)
        for k in range(ORDER, 0, -1):
            if not len(todo):
                return total
            grams, p, _ = tables[k]
            g = packed(a, k)[todo]
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            hit = (grams[at] == g) & ~np.isnan(p[at])
            total[todo[hit]] += p[at[hit]]
            todo, g = todo[~hit], g[~hit] >> BITS
            grams, _, back = tables[k - 1]
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            known = (grams[at] == g) & ~np.isnan(back[at])
            total[todo[known]] += back[at[known]]
        total[todo] += self.unseen[lang]
        return total

    def longest(self, grams: np.ndarray, lang: str) -> np.ndarray:
        """Log-probabilities of longest n-grams; not a number where the table has none."""
        if lang not in self.tables:
            return np.full(len(grams), np.nan)
        known, p, _ = self.tables[lang][ORDER]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[at] == grams, p[at].astype(np.float64), np.nan)

    def perplexity(self, text: str | None, lang: str) -> float | None:
        a = symbols(text)
        if len(a) < ORDER or not self.tables:
            return None
        langs = [lang] if lang in self.tables else list(self.tables)
        return float(np.exp(min(-self.log_p(a, x).mean() for x in langs)))


def model_table(trusted: DataFrame) -> DataFrame:
    """The model of all of ``trusted`` (``lang``, ``text``) as ``probabilities`` gives it, whole, with the counts ``n`` of the longest n-grams."""
    counts = written(gram_counts(trusted), "grams")
    rows = probabilities(counts).join(counts.withColumn("k", F.lit(ORDER)), ["lang", "k", "gram"], "left")
    return written(rows.withColumn("p", F.col("p").cast("float")).withColumn("back", F.col("back").cast("float")), "model")


def in_memory(rows: DataFrame) -> KneserNey:
    """The n-grams of ``rows`` as packed arrays."""
    floats = lambda x: x.to_numpy(np.float64).astype("<f4").tobytes()

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("gram")
        return pd.DataFrame({"lang": [x.lang.iloc[0]], "k": [x.k.iloc[0]], "gram": [x.gram.to_numpy("<i8").tobytes()], "p": [floats(x.p)], "back": [floats(x.back)]})

    # one row of packed arrays for each language and order
    packed_rows = rows.select("lang", "k", "gram", "p", "back").groupBy("lang", "k").applyInPandas(pack, "lang string, k int, gram binary, p binary, back binary").collect()
    nothing = (np.array([-1]), np.array([np.nan]), np.array([np.nan]))
    tables: dict = {r.lang: {k: nothing for k in range(ORDER + 1)} for r in packed_rows}
    for r in packed_rows:
        tables[r.lang][r.k] = (np.frombuffer(r.gram, "<i8"), np.frombuffer(r.p, "<f4"), np.frombuffer(r.back, "<f4"))
    return KneserNey(tables, {lang: -float(np.log(np.count_nonzero(~np.isnan(t[1][1])) + 1)) for lang, t in tables.items()})  # contexts that are no n-gram have no probability


def fitted(trusted: DataFrame) -> KneserNey:
    """The whole model of ``trusted`` (``lang``, ``text``), for trusted text of bounded size."""
    return in_memory(model_table(trusted))


def frequent(rows: DataFrame, most: int) -> DataFrame:
    """The longest n-grams of the model that occur most often, ``most`` at the most."""
    longest = rows.where(F.col("k") == ORDER)
    total, n = 0, None
    for r in longest.groupBy("n").count().orderBy(F.desc("n")).limit(most).toLocalIterator():
        total += r["count"]
        if total > most:
            break
        n = r.n
    return longest.where(F.lit(False) if n is None else F.col("n") >= n)


def log_probabilities(grams: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, gram, p`` for each of the distinct longest n-grams ``grams`` (``lang, gram``) under the whole model, by joins with
    its tables of each order: the longest known n-gram's probability, and the weights of the contexts that were new before it."""
    unseen = rows.where("k = 1 and p is not null").groupBy("lang").agg((-F.ln(F.count("*") + 1)).alias("p"))  # one row for each language
    todo, sums = grams.withColumn("sum", F.lit(0.0)), []
    for k in range(ORDER, 0, -1):
        todo = todo.withColumn("key", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).withColumn("context", F.shiftright("key", BITS))
        known = rows.where((F.col("k") == k) & F.col("p").isNotNull()).select("lang", F.col("gram").alias("key"), "p")
        weight = rows.where((F.col("k") == k - 1) & F.col("back").isNotNull()).select("lang", F.col("gram").alias("context"), "back")
        met = written(todo.join(known, ["lang", "key"], "left").join(weight, ["lang", "context"], "left"), f"scored{k}")
        sums.append(met.where("p is not null").select("lang", "gram", (F.col("sum") + F.col("p")).alias("p")))
        todo = met.where("p is null").select("lang", "gram", (F.col("sum") + F.coalesce("back", F.lit(0.0))).alias("sum"))
    sums.append(todo.join(F.broadcast(unseen), "lang").select("lang", "gram", (F.col("sum") + F.col("p")).alias("p")))
    out = sums[0]
    for x in sums[1:]:
        out = out.unionByName(x)
    return out


def perplexities(docs: DataFrame, rows: DataFrame, most: int = 3_000_000) -> DataFrame:
    """``doc_id, lang, perplexity`` for each row under the model ``rows`` (``model_table``); null for a text without words or an empty model.

    A model of up to ``most`` n-grams is broadcast and scores each document in place. Of a larger one the ``most`` most frequent longest
    n-grams are; the others that a document has, counted by document, meet the whole tables of all orders by joins. Both give the
    same perplexities: what is broadcast decides where an n-gram is scored, not how.
    """
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit("")))
    spark = docs.sparkSession
    whole = rows.count() <= most
    model = in_memory(rows if whole else frequent(rows, most))
    shared = spark.sparkContext.broadcast(model)

    if whole:

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                p = [shared.value.perplexity(t, g) for t, g in zip(x.text, x.lang, strict=True)]
                yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "lang": x.lang.to_numpy(object), "perplexity": pd.Series(p, dtype=float).to_numpy()})

        out = id_back(id_text(docs, "lang", "text").mapInPandas(batches, "doc_id string, lang string, perplexity double"))
        return out.withColumn("perplexity", F.nanvl("perplexity", F.lit(None)))

    langs = sorted(r.lang for r in rows.where("k = 0").select("lang").distinct().collect())
    known = set(langs)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for row, text, own in zip(x.row, x.text, x.lang, strict=True):
                a = symbols(text)
                if len(a) < ORDER:
                    continue
                grams, n = np.unique(packed(a, ORDER), return_counts=True)
                for lang in [own] if own in known else langs:
                    p = shared.value.longest(grams, lang)
                    new = np.isnan(p)
                    out.append((row, lang, int(n.sum()), float((p * n)[~new].sum()), grams[new], n[new]))
            yield pd.DataFrame(out, columns=["row", "lang", "size", "sum", "grams", "n"])

    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text"), "keyed")
    first = written(keyed.select("row", "lang", "text").mapInPandas(parts, "row long, lang string, size long, sum double, grams array<long>, n array<long>"), "parts")
    rest = first.select("row", "lang", F.explode(F.arrays_zip("grams", "n")).alias("x")).select("row", "lang", F.col("x.grams").alias("gram"), F.col("x.n").alias("n"))
    counts = rest.groupBy("lang", "gram").agg(F.count("*").alias("rows"))
    counts = written(counts, "asked")
    scored = written(log_probabilities(counts.select("lang", "gram"), rows).join(counts, ["lang", "gram"]), "known")
    key = lambda x: x.withColumn("key", F.struct("lang", "gram")).drop("lang", "gram")
    sums = attach(key(rest), key(scored), "key", "rows").groupBy("row", F.col("key.lang").alias("lang")).agg(F.sum(F.col("p") * F.col("n")).alias("more"))
    each = first.select("row", "lang", "size", "sum").join(sums, ["row", "lang"], "left")
    best = each.groupBy("row").agg(F.min(F.exp(-(F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.col("size"))).alias("perplexity"))
    return keyed.select("row", "doc_id", "lang").join(best, "row", "left").select("doc_id", "lang", "perplexity")


def quantiles(values: DataFrame, x: str, q: float, key: str) -> DataFrame:
    """``key, quantile``: exactly, with the straight line between two ranks, from counts by value and their running sums."""
    counts = running_sums(values.where(F.col(x).isNotNull()).groupBy(key, x).agg(F.count("*").alias("n")), x, ["n"], [key])
    counts = counts.join(values.where(F.col(x).isNotNull()).groupBy(key).agg(((F.count("*") - 1) * F.lit(q)).alias("at")), key)
    from_ = lambda rank: F.min(F.when(F.col("n_upto") > rank, F.col(x)))
    t = counts.groupBy(key, "at").agg(from_(F.floor("at")).alias("low"), from_(F.ceil("at")).alias("high"))
    return t.select(key, (F.col("low") + (F.col("at") - F.floor("at")) * (F.col("high") - F.col("low"))).alias("quantile"))


def held_out(key: Column, share: int = 5) -> Column:
    """One trusted document of ``share``: the model does not learn from it, and the thresholds come from these only."""
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(share)) == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, margin: float = 1.15, most: int = 3_000_000) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, keep`` for each row of ``docs``.

    Trusted text: documents that ``labels`` (``doc_id, quality, toxic``) call good and not toxic. The model is trained on four fifths of it, chosen
    by a hash of the id; a language's threshold is ``margin`` times the exact ``quantile`` of the perplexities of the others, which the
    model has not seen; a language without any takes the quantile of all. A document is kept if its perplexity is not above. Null or wordless
    texts have no perplexity and are not kept; without thresholds nothing can be judged and the others are kept. Null languages are
    one language. Rows that repeat an id are each judged by their own text.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    trusted = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text is not null").where(~held_out(F.col("doc_id")))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 19))
    some = F.broadcast(good.where(~held_out(F.col("doc_id"))).select(bucket.alias("_bucket")).distinct())  # 2^19 numbers at most, whatever the labels: spares most other texts the shuffle
    trusted = trusted.withColumn("_bucket", bucket).join(some, "_bucket", "left_semi").drop("_bucket").join(good, "doc_id", "left_semi")
    scored = written(perplexities(docs, model_table(trusted), most), "scored")
    known = written(scored.where(held_out(F.col("doc_id"))).join(good, "doc_id", "left_semi").where("perplexity is not null"), "known")
    every = quantiles(known.withColumn("whole", F.lit(1)), "perplexity", quantile, "whole").first()
    own = quantiles(known, "perplexity", quantile, "lang").select("lang", (F.col("quantile") * margin).alias("own"))
    out = scored.join(F.broadcast(own), "lang", "left")  # one row for each language
    out = out.withColumn("threshold", F.coalesce("own", F.lit(every and every["quantile"] * margin).cast("double")))
    has_words = F.col("perplexity").isNotNull()
    keep = F.when(F.col("threshold").isNull(), F.lit(True)).otherwise(has_words & (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(keep, F.lit(False)).alias("keep"))
