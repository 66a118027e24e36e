"""Forward-looking labels. Only labels look ahead; features never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import KEY, series
from .timegrid import trim_tail


def sign_label(p: int, null_tail: bool = False, close: str = "close") -> Column:
    """1 if the log return over the next ``p`` rows is positive, else 0; the tail is 0, or null on request."""
    later = F.lead(close, p).over(series())
    up = F.coalesce((F.ln(F.try_divide(later, F.col(close))) > 0).cast("tinyint"), F.lit(0).cast("tinyint"))
    return F.when(later.isNotNull(), up) if null_tail else up


def beyond_costs(p: int, bps: float, sides: int = 1, null_tail: bool = False, close: str = "close") -> Column:
    """1 if the price rises by more than ``bps`` of it; with ``sides`` 2 also -1 if it falls by more."""
    later = F.lead(close, p).over(series())
    move, cost = later - F.col(close), F.col(close) * (bps / 1e4)
    out = F.when(move > cost, 1)
    out = (out.when(move < -cost, -1) if sides == 2 else out).otherwise(0).cast("tinyint")
    return F.when(later.isNotNull(), out) if null_tail else out


def triple_barrier(df: DataFrame, p: int, up: float, down: float, tag: str) -> DataFrame:
    """``decision, touch, touched, touch_up, touch_down`` (with ``_tag``): the first of the next ``p`` rows whose high reaches
    ``close * (1 + up)`` (looked at first) or whose low reaches ``close * (1 - down)``; rows without high or low are passed over.

    Without a touch the sign of the final move decides. Null where fewer than ``p`` rows follow or a close is null.
    The next rows are an array of ``p`` pairs in the row, so ``p`` should be some hundreds at most.
    """
    by = series()
    ahead = F.collect_list(F.struct("high", "low")).over(by.rowsBetween(1, p))
    t = df.withColumns({"_ahead": ahead, "_last": F.lead("close", p).over(by), "_there": F.lead("ts", p).over(by)})
    high, low = F.col("close") * (1 + up), F.col("close") * (1 - down)
    hits = F.filter("_ahead", lambda x: x.high.isNotNull() & x.low.isNotNull() & ((x.high >= high) | (x.low <= low)))
    first = F.get(F.transform(hits, lambda x: F.when(x.high >= high, 1).otherwise(-1)), F.lit(0))
    known = F.col("_there").isNotNull() & F.col("_last").isNotNull() & F.col("close").isNotNull()
    t = t.withColumn("_hit", F.when(known, F.coalesce(first, F.lit(0)))).withColumn("_sign", F.signum(F.col("_last") - F.col("close")).cast("int"))
    side = F.when(F.col("_hit") == 1, "UP").when(F.col("_hit") == -1, "DOWN").when(F.col("_hit") == 0, "NO_TOUCH")
    return t.withColumns({
        f"decision_{tag}": F.when(F.col("_hit") != 0, F.col("_hit")).when(F.col("_hit") == 0, F.col("_sign")).cast("tinyint"),
        f"touch_{tag}": side,
        f"touched_{tag}": (F.col("_hit") != 0).cast("tinyint"),
        f"touch_up_{tag}": (F.col("_hit") == 1).cast("tinyint"),
        f"touch_down_{tag}": (F.col("_hit") == -1).cast("tinyint"),
    }).drop("_ahead", "_last", "_there", "_hit", "_sign")


def touch_summary(df: DataFrame, tags: list[str]) -> DataFrame:
    """``horizon, p_touch, p_up_given_touch`` for each tag, in one aggregation."""
    one = df.agg(*[f(F.col(f"{c}_{t}").cast("double")).alias(f"{c}_{t}_{n}") for t in tags for n, c, f in (("m", "touched", F.avg), ("s", "touched", F.sum), ("s", "touch_up", F.sum))])
    row = lambda t: F.struct(F.lit(t).alias("horizon"), F.col(f"touched_{t}_m").alias("p_touch"), F.try_divide(f"touch_up_{t}_s", F.col(f"touched_{t}_s")).alias("p_up_given_touch"))
    return one.select(F.inline(F.array(*map(row, tags))))


def hazard(df: DataFrame, steps: int, barrier: float, side: str = "both", price: str = "close") -> DataFrame:
    """``hazard_step_1`` to ``hazard_step_H``: 1 at the first step whose return crosses the barrier, else 0."""
    by = series()
    ahead = F.collect_list(F.coalesce(F.col(price), F.lit(float("inf")))).over(by.rowsBetween(1, steps))
    r = lambda p: F.when(p < float("inf"), F.try_divide(p, F.col(price)) - 1)
    test = {"up": lambda x: x >= barrier, "down": lambda x: x <= -barrier, "both": lambda x: (x >= barrier) | (x <= -barrier)}[side]
    crossed = F.transform(F.col("_ahead"), lambda p: F.coalesce(test(r(p)), F.lit(False)))
    t = df.withColumn("_ahead", ahead).withColumn("_hit", F.array_position(crossed, True))
    return t.withColumns({f"hazard_step_{s}": (F.col("_hit") == s).cast("double") for s in range(1, steps + 1)}).drop("_ahead", "_hit")


def time_to_event(steps: int) -> Column:
    """The first step with a hazard, null if none."""
    return F.coalesce(*[F.when(F.col(f"hazard_step_{s}") > 0, s) for s in range(1, steps + 1)])


def targets(df: DataFrame, p: int) -> DataFrame:
    """``target_cls`` and no tail: what a classifier is trained on."""
    return trim_tail(df.withColumn("target_cls", sign_label(p)), p, "target_cls")


def regression_target(df: DataFrame, p: int) -> DataFrame:
    """``target_reg`` (the close ``p`` rows ahead) and ``target_cls`` (whether it is higher); rows without a future go."""
    t = df.withColumn("target_reg", F.lead("close", p).over(series(*KEY)))
    return t.withColumn("target_cls", F.coalesce((F.col("target_reg") > F.col("close")).cast("tinyint"), F.lit(0).cast("tinyint"))).where("target_reg is not null")
