"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions only: patterns, spans and likelihoods are expressions over the text, inside one projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import written

#: Fixed patterns of the contract. A match of the first is dropped if its second group has under 12 characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: Whole runs, so the least length can be in the pattern: 18 with its prefix, and 16.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def before(steps: Column) -> Column:
    """For each of an array of integers the sum of those before it.

    Arrays grow by copying, so the sums run inside blocks of the square root of the size, and then over the blocks: 64,000
    steps copy 16 million integers instead of two billion.
    """
    none = F.array().cast("array<int>")
    walk = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.struct((a.at + x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")))
    join = lambda a, p: F.struct((a.at + p.at).alias("at"), F.concat(a.out, F.array(F.transform(p.out, lambda o: o + a.at))).alias("out"))

    def summed(n: Column) -> Column:
        room = F.ceil(F.sqrt(F.size(n))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / room).cast("int")), lambda k: F.slice(n, k * room + 1, room))
        return F.aggregate(F.transform(blocks, walk), F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), join, lambda a: F.flatten(a.out))

    return let(steps, lambda n: F.when(F.size(n) > 0, summed(n)).otherwise(none))


def spans(text: Column, pattern: str, kind: int, value: Callable[[Column], Column] = lambda m: m) -> Column:
    """All leftmost non-overlapping matches with their places in code points; ``value``: what is kept of a match.

    The pieces between matches, and the matches, in turn add up to the places.
    """

    def placed(t: Column, found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(t, pattern), 1, F.size(found)), F.char_length)
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), (g + F.char_length(m)).alias("n")))
        starts = let(steps, lambda s: F.zip_with(before(F.transform(s, lambda x: x.n)), s, lambda at, x: at + x.gap))
        return F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.char_length(m)).alias("end"), value(m).alias("value")))

    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return let(text, lambda t: let(found(t), lambda f: F.when(F.size(f) > 0, placed(t, f)).otherwise(F.array().cast(SPANS))))


def assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def base_spans(text: Column) -> Column:
    assign = F.filter(spans(text, ASSIGN, 0, assigned), lambda s: F.char_length(s.value) >= ASSIGN_LEAST)
    return F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))


def blanked(text: Column) -> Column:
    """``text`` with spaces for matches of the fixed patterns, each found in what the ones before it left; places stay."""
    spaces = lambda m: F.repeat(F.lit(" "), F.char_length(m))
    long_one = lambda m: F.when(F.char_length(assigned(m)) < ASSIGN_LEAST, m).otherwise(spaces(m))

    def without(text: Column, pattern: str, blank: Callable[[Column], Column]) -> Column:
        pieces = lambda t, found: F.zip_with(F.split(t, pattern), found, lambda g, m: F.concat(g, F.coalesce(blank(m), F.lit(""))))
        whole = lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, F.array_join(pieces(t, f), "")).otherwise(t))
        return let(text, whole)

    return without(without(without(text, ASSIGN, long_one), ACCESS, spaces), HEX, spaces)


def labelled_samples(docs: DataFrame, sample: int = 4_000) -> DataFrame:
    """``text, secret``: matches of the fixed patterns, and words of letters as ordinary identifiers, from about ``sample``
    documents that a hash of the text chooses."""
    share = min(1.0, sample / max(1, docs.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = docs.where(F.shiftrightunsigned(F.xxhash64("text"), 33) < int(share * 2**31)).select(text.alias("text"))
    secret = chosen.select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s.value)).alias("text"), F.lit(True).alias("secret"))
    plain = chosen.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_]+\b"), F.lit(0))).alias("text"), F.lit(False).alias("secret"))
    return secret.unionByName(plain)


def sample_words(samples: DataFrame) -> DataFrame:
    """``text, secret, n``: each distinct sample with its number; written."""
    return written(samples.groupBy("secret", "text").agg(F.count("*").alias("n")), "samples")


def log_ratios(samples: DataFrame, weight: float = 20.0) -> list[float]:
    """For each pair of characters of ``ALPHABET``: log P(second | first) under random strings less that under identifiers.

    Both are mixed with the uniform distribution, at the weight of ``weight`` observations of the first character; so
    without samples every ratio is 0. The table has one entry for each pair, whatever the number of samples. A sample counts ``n`` times, once
    if there is no such column; its pairs are made inside its row, so the work is linear in its length.
    """
    k = len(ALPHABET)
    n = F.col("n") if "n" in samples.columns else F.lit(1)
    letters = samples.where("char_length(text) > 1").select("secret", n.alias("n"), F.split("text", "").alias("c"))
    both = F.zip_with("c", F.slice("c", 2, F.size("c")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = letters.select("secret", "n", F.explode(both).alias("x")).select("secret", "n", "x.*").where("a <> '' and b <> ''")
    pairs = pairs.select("secret", "n", F.expr(f"instr('{ALPHABET}', a) - 1").alias("a"), F.expr(f"instr('{ALPHABET}', b) - 1").alias("b")).where("a >= 0 and b >= 0")
    counts = {True: [0.0] * k * k, False: [0.0] * k * k}
    for r in pairs.groupBy("secret", "a", "b").agg(F.sum("n").alias("count")).collect():
        counts[r.secret][r.a * k + r.b] = float(r["count"])
    p = {}
    for label, n in counts.items():
        rows = [sum(n[i * k : (i + 1) * k]) for i in range(k)]
        p[label] = [(n[i * k + j] + weight / k) / (rows[i] + weight) for i in range(k) for j in range(k)]
    return [math.log(x / y) for x, y in zip(p[True], p[False], strict=True)]


def likelihood(value: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio over a string's pairs of characters (which must all be of ``ALPHABET``)."""
    k = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    step = lambda acc, c: F.struct((acc.sum + F.when(acc.last >= 0, F.get(table, acc.last * k + c)).otherwise(0.0)).alias("sum"), c.alias("last"))
    total = F.aggregate(F.filter(codes, lambda c: c >= 0), F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), step, lambda acc: acc.sum)
    return F.try_divide(total, F.char_length(value) - 1)


def fitted_least(samples: DataFrame, ratios: list[float], fewest: int = 20, otherwise: float = 0.5) -> float:
    """The mean log-likelihood ratio that parts the distinct samples of 16 characters or more best: the share of secrets below it and that of
    identifiers from it on are least in sum; the middle of all such values, in steps of 0.05. ``otherwise`` where one of the classes has fewer
    than ``fewest`` such samples."""
    step = F.floor(F.greatest(F.least(likelihood(F.col("text"), ratios), F.lit(10.0)), F.lit(-10.0)) / 0.05).cast("int")
    bins = samples.where(F.col("text").rlike(f"^{CANDIDATE}$")).groupBy("secret", step.alias("at")).count().collect()  # 400 a class at most
    total = {c: sum(r["count"] for r in bins if r.secret == c) for c in (True, False)}
    if min(total.values()) < fewest:
        return otherwise
    wrong = lambda t: sum(r["count"] / total[r.secret] for r in bins if (r["at"] < t) == r.secret)
    costs = {t: wrong(t) for t in range(-200, 202)}
    best = [t for t, c in costs.items() if c <= min(costs.values()) + 1e-12]
    return (best[0] + best[-1]) / 2 * 0.05


def scan(docs: DataFrame, samples: DataFrame | None = None, least: float | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``base`` and ``found``: arrays of ``start, kind, end, value``, ordered by start and kind.

    ``base``: matches of the fixed patterns (kinds 0 to 2 of ``KINDS``). ``found`` adds strings of 16 or more characters of the text
    without these (:func:`blanked`) that have letters and digits or both cases, and whose mean log-likelihood ratio is ``least`` or
    more (by default :func:`fitted_least`). The models are trained from ``samples`` (``text, secret``), by default
    :func:`labelled_samples`. Null texts are empty; each row is judged by itself.
    """
    words = sample_words(samples if samples is not None else labelled_samples(docs))
    ratios = log_ratios(words)
    least = fitted_least(words, ratios) if least is None else least
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_tm_text"), F.array_sort(base_spans(text)).alias("base"))
    mixed = lambda v: v.rlike("[0-9]") | (v.rlike("[a-z]") & v.rlike("[A-Z].*[A-Z]"))
    left = F.when(F.size("base") > 0, blanked(F.col("_tm_text"))).otherwise(F.col("_tm_text"))
    more = F.filter(spans(left, CANDIDATE, 3), lambda s: mixed(s.value))
    more = F.filter(more, lambda s: likelihood(s.value, ratios) >= least)
    return base.select(*keep, "base", F.array_sort(F.concat("base", more)).alias("found"))


def joined(found: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def secret_spans(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row."""
    out = scan(docs, **options)
    n = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
