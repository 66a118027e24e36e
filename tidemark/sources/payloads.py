"""Landed raw payloads (``payload`` text) into typed series: JSON of several shapes, parsed as variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.arrays import let
from ..functions.scalars import safe_double
from ..operators.timegrid import floor_to, keep_last
from ..operators.windows import chained_change

#: Where a payload has its points, and what the parts of a point are called (fixed values).
LISTS = ("data", "values", "series", "entries", "points")
TIMES = ("timestamp", "time", "ts", "t", "x")
VALUES = ("value", "v", "y")


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def first_of(v: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[text_at(v, f"$.{n}") for n in names])


def points(payloads: DataFrame, keys: Sequence[str] = ("symbol",), arrival: str | None = None) -> DataFrame:
    """``p``, one variant for each point of the list that a payload is or holds, under one of ``LISTS``, at most one level down; ``_at``: its
    order, by the payload's ``arrival`` (without one, by its text) and the place in it."""
    v = F.try_parse_json("payload")
    paths = ["$", *[f"$.{a}" for a in LISTS], *[f"$.{a}.{b}" for a in LISTS for b in LISTS]]
    lists = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths])
    out = payloads.select(*keys, F.col(arrival or "payload").alias("_payload"), F.posexplode(lists).alias("_place", "p"))
    return out.select(*keys, "p", F.struct("_payload", "_place").alias("_at"))


def when_of(v: Column) -> Column:
    """A point's time, from epoch seconds (or milliseconds) or ISO text, under one of ``TIMES`` or first in a list."""
    s = F.coalesce(first_of(v, TIMES), text_at(v, "$[0]"))
    n = safe_double(s)
    return F.coalesce(F.timestamp_seconds(F.when(n > 1e11, n / 1000).otherwise(n)), F.try_to_timestamp(s))


def chart_series(payloads: DataFrame, value_names: Sequence[str] = VALUES, start: Column | None = None, end: Column | None = None, keys: Sequence[str] = ("symbol",), arrival: str | None = None) -> DataFrame:
    """``ts, value``: points without time or value, and those out of the range, go; of equal times the last stays."""
    p = points(payloads, keys, arrival)
    t = p.select(*keys, "_at", when_of(F.col("p")).alias("ts"), safe_double(F.coalesce(first_of(F.col("p"), value_names), text_at(F.col("p"), "$[1]"))).alias("value"))
    t = t.where("ts is not null and value is not null")
    if start is not None:
        t = t.where(F.col("ts") >= start)
    if end is not None:
        t = t.where(F.col("ts") <= end)
    return keep_last(t, [*keys, "ts"], "_at").drop("_at")


def histogram(v: Column) -> Column:
    """Fee histogram of a variant: ``{bins, counts}``, or a list of pairs or of objects whose size is positive."""
    zipped = arrays.zipped_histogram(F.try_variant_get(v, "$.bins", "array<double>"), F.try_variant_get(v, "$.counts", "array<double>"))
    rate = lambda x: let(F.coalesce(first_of(x, ("feerate", "fee", "rate")), text_at(x, "$[0]")), safe_double)
    size = lambda x: let(F.coalesce(first_of(x, ("vsize", "size", "weight", "count")), text_at(x, "$[1]")), safe_double)
    pairs = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(rate(x).alias("rate"), size(x).alias("size")))
    return F.coalesce(zipped, arrays.positive(pairs))


def fee_series(payloads: DataFrame, keys: Sequence[str] = ("symbol",), zero_as_missing: bool = True, arrival: str | None = None) -> DataFrame:
    """``ts, wavg, p50, p90, vsize`` from objects or five-tuples; what is missing (or zero) comes from the point's histogram."""
    v = F.col("p")
    whole = F.coalesce(F.try_variant_get(v, "$.histogram", "variant"), F.try_variant_get(v, "$.fee_histogram", "variant"))
    hist = F.col("_hist")
    stat = {"wavg": arrays.weighted_mean(hist), "p50": arrays.weighted_percentile(hist, 0.5), "p90": arrays.weighted_percentile(hist, 0.9), "vsize": arrays.summed(hist, lambda x: x["size"])}
    names = {"wavg": ("wavg", "avg", "avgFee"), "p50": ("p50", "median"), "p90": ("p90",), "vsize": ("vsize", "mempool_vsize")}
    got = {n: safe_double(F.coalesce(first_of(v, names[n]), text_at(v, f"$[{i}]"))) for i, n in enumerate(names, 1)}
    own = {n: F.nullif(c, F.lit(0.0)) if zero_as_missing else c for n, c in got.items()}
    p = points(payloads, keys, arrival).withColumn("_hist", let(whole, histogram))  # a column of its own: it has many uses
    t = p.select(*keys, "_at", when_of(v).alias("ts"), *[F.coalesce(own[n], stat[n]).alias(n) for n in names])
    return keep_last(t, [*keys, "ts"], "_at").drop("_at")


def difficulty_series(payloads: DataFrame, keys: Sequence[str] = ("symbol",), arrival: str | None = None) -> DataFrame:
    """``ts, height, difficulty, change`` from objects or tuples ``[ts, height, difficulty, next or change]``; an absent change is
    ``(next - difficulty) * 100``, and otherwise chained from the row before."""
    v = F.col("p")
    pick = lambda names, i: safe_double(F.coalesce(first_of(v, names), text_at(v, f"$[{i}]")))
    p = points(payloads, keys, arrival)
    t = p.select(*keys, "_at", when_of(v).alias("ts"), pick(("height",), 1).alias("height"), pick(("difficulty",), 2).alias("difficulty"), pick(("next", "nextDifficulty"), 3).alias("_next"), safe_double(F.coalesce(first_of(v, ("change", "difficultyChange")), text_at(v, "$[4]"))).alias("change"))
    t = keep_last(t, [*keys, "ts"], "_at").drop("_at").withColumn("change", F.coalesce("change", (F.col("_next") - F.col("difficulty")) * 100)).drop("_next")
    return chained_change(t, "difficulty", "change", keys)


def snapshot(payloads: DataFrame, seconds: int = 900, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mempool snapshots (``fetched_at``, ``payload``) stamped to the grid: counts, histogram statistics and recommended fees, where the
    economy fee stands in for a missing minimum."""
    num = lambda *names: safe_double(F.coalesce(*[text_at(F.col("_v"), f"$.{n}") for n in names]))
    hist = F.col("_hist")
    # columns of their own: inside expressions each of their many uses, some for each element, would parse the text again
    parsed = payloads.select(*keys, "fetched_at", F.try_parse_json("payload").alias("_v"))
    parsed = parsed.withColumn("_hist", let(F.try_variant_get("_v", "$.fee_histogram", "variant"), histogram))
    return parsed.select(
        *keys, floor_to(F.col("fetched_at"), seconds).alias("ts"), num("count").alias("onch_mempool_count"), num("vsize").alias("onch_mempool_vsize_vB"), num("total_fee").alias("onch_mempool_total_fee_sat"),
        num("fastestFee").alias("onch_fee_fast_satvb"), num("halfHourFee").alias("onch_fee_30m_satvb"), num("hourFee").alias("onch_fee_60m_satvb"), num("minimumFee", "economyFee").alias("onch_fee_min_satvb"),
        arrays.weighted_mean(hist).alias("onch_fee_wavg_satvb"), arrays.weighted_percentile(hist, 0.5).alias("onch_fee_p50_satvb"), arrays.weighted_percentile(hist, 0.9).alias("onch_fee_p90_satvb"),
    )
