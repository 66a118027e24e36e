"""First crossings far ahead: a pyramid of block extremes instead of an array of the next rows in each row.

Level 0 of the pyramid is the rows of a series by number; a unit of each level above has the highest ``hi`` and the lowest ``lo`` of ``2^bits`` units of
the level below. A row looks for its first crossing upwards: at each level among the units from its place to the end of the unit above, then one
level higher behind that; and then downwards, inside the first unit that has a crossing. Every step is a join with one unit, which
holds its ``2^bits`` parts, so that a row meets ``2^bits`` numbers a level, however far the horizon.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import KEY
from ..sources.shared import written
from .parts import numbered

KEYS = list(KEY)


def pyramid(rows: DataFrame, levels: int, bits: int) -> list[DataFrame]:
    """``symbol, interval, at, parts`` for each level: ``parts`` are the number, ``hi`` and ``lo`` of each unit of the level inside unit ``at`` of the next."""
    now, out = rows.select(*KEYS, F.col("n").alias("i"), "hi", "lo"), []
    for _ in range(levels):
        parts = F.array_sort(F.collect_list(F.struct("i", "hi", "lo"))).alias("parts")
        out.append(written(now.groupBy(*KEYS, F.shiftright("i", bits).alias("at")).agg(parts, F.max("hi").alias("hi"), F.min("lo").alias("lo")), "level"))
        now = out[-1].select(*KEYS, F.col("at").alias("i"), "hi", "lo")
    return [level.select(*KEYS, "at", "parts") for level in out]


def first_crossing(rows: DataFrame, p: int, crosses: Callable[[Column], Column], bits: int = 6) -> DataFrame:
    """``symbol, interval, n, hit``: for each row (``n``: its number in the series; other columns as ``crosses`` names them) that has one, the first of the
    next ``p`` rows that crosses, a struct of its number ``i``, ``hi`` and ``lo``.

    ``crosses`` tells of a struct ``hi, lo`` whether it crosses the row's barriers; a unit must cross if one of its rows does, as comparisons of ``hi``
    upwards and of ``lo`` downwards do. Null means no. ``rows`` (with ``hi, lo``) should be a written table; it is shuffled once a level.
    """
    top = 1
    while 1 << (bits * top) <= p:
        top += 1
    levels = pyramid(rows, top + 2, bits)
    first = lambda df, test: df.withColumn("hit", F.get(F.filter("parts", lambda x: test(x) & F.coalesce(crosses(x), F.lit(False))), F.lit(0))).drop("parts", "at")
    looking, found = rows.drop("hi", "lo").withColumn("from", F.col("n") + 1), []
    for k, level in enumerate(levels):
        last = F.shiftright(F.col("n") + p, bits * k)  # the unit of this level in which the horizon ends
        met = looking.withColumn("at", F.shiftright("from", bits)).join(level, [*KEYS, "at"])
        met = written(first(met, lambda x, last=last: (x.i >= F.col("from")) & (x.i <= last)), "up")
        found.append(met.where("hit is not null").drop("from"))
        looking = met.where("hit is null").drop("hit").withColumn("from", F.shiftright("from", bits) + 1)
        looking = looking.where(F.col("from") <= F.shiftright(F.col("n") + p, bits * (k + 1)))
    now = None
    for k in range(len(levels) - 1, -1, -1):  # those of level k and those opened from above
        now = found[k] if now is None else now.unionByName(found[k])
        if k:
            now = first(now.withColumn("at", F.col("hit.i")).drop("hit").join(levels[k - 1], [*KEYS, "at"]), lambda x: F.lit(True))
    return now.where(F.col("hit.i") <= F.col("n") + p).select(*KEYS, "n", "hit")


def _numbered(df: DataFrame) -> DataFrame:
    return written(numbered(df, KEYS, ["ts"], "_n").drop("_part"), "numbered")


def far_barrier(df: DataFrame, p: int, up: float, down: float, tag: str, bits: int = 6) -> DataFrame:
    """What :func:`~tidemark.operators.labels.triple_barrier` gives, for horizons ``p`` of thousands of rows."""
    t = _numbered(df)
    both = F.col("high").isNotNull() & F.col("low").isNotNull()
    rows = t.select(*KEYS, F.col("_n").alias("n"), F.when(both, F.col("high")).alias("hi"), F.when(both, F.col("low")).alias("lo"), (F.col("close") * (1 + up)).alias("upper"), (F.col("close") * (1 - down)).alias("lower"))
    hit = first_crossing(written(rows, "barriers"), p, lambda x: (x.hi >= F.col("upper")) | (x.lo <= F.col("lower")), bits)
    ahead = t.select(*KEYS, (F.col("_n") - p).alias("_n"), F.col("close").alias("_last"), F.lit(True).alias("_there"))
    t = t.join(hit.select(*KEYS, F.col("n").alias("_n"), F.col("hit.hi").alias("_hi")), [*KEYS, "_n"], "left").join(ahead, [*KEYS, "_n"], "left")
    side = F.when(F.col("_hi").isNull(), 0).when(F.col("_hi") >= F.col("close") * (1 + up), 1).otherwise(-1)
    known = F.col("_there") & F.col("_last").isNotNull() & F.col("close").isNotNull()
    t = t.withColumn("_hit", F.when(known, side)).withColumn("_sign", F.signum(F.col("_last") - F.col("close")).cast("int"))
    return t.withColumns({
        f"decision_{tag}": F.when(F.col("_hit") != 0, F.col("_hit")).when(F.col("_hit") == 0, F.col("_sign")).cast("tinyint"),
        f"touch_{tag}": F.when(F.col("_hit") == 1, "UP").when(F.col("_hit") == -1, "DOWN").when(F.col("_hit") == 0, "NO_TOUCH"),
        f"touched_{tag}": (F.col("_hit") != 0).cast("tinyint"),
        f"touch_up_{tag}": (F.col("_hit") == 1).cast("tinyint"),
        f"touch_down_{tag}": (F.col("_hit") == -1).cast("tinyint"),
    }).select(*df.columns, *[f"{c}_{tag}" for c in ("decision", "touch", "touched", "touch_up", "touch_down")])


def first_event(df: DataFrame, steps: int, barrier: float, side: str = "both", price: str = "close", bits: int = 6) -> DataFrame:
    """``df`` with ``event_step``: the first of the next ``steps`` steps whose return crosses the barrier, null if none does. Where
    :func:`~tidemark.operators.labels.hazard` has a column a step, this has their place of the 1. Prices are positive."""
    t, x = _numbered(df), F.col(price).cast("double")
    rows = written(t.select(*KEYS, F.col("_n").alias("n"), x.alias("hi"), x.alias("lo"), x.alias("own")), "events")
    change = lambda v: F.try_divide(v, F.col("own")) - 1
    test = {"up": lambda v: change(v.hi) >= barrier, "down": lambda v: change(v.lo) <= -barrier, "both": lambda v: (change(v.hi) >= barrier) | (change(v.lo) <= -barrier)}[side]
    hit = first_crossing(rows, steps, test, bits).select(*KEYS, F.col("n").alias("_n"), (F.col("hit.i") - F.col("n")).cast("int").alias("event_step"))
    return t.join(hit, [*KEYS, "_n"], "left").select(*df.columns, "event_step")
