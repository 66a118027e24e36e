"""Leakage-aware splits. Fold bounds are a few rows; rows are put into folds by a range join against them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import KEY, series


def positions(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Adds ``_pos`` (from 0) and ``_rows`` to each row of a series."""
    return df.withColumns({"_pos": F.row_number().over(series(*keys)) - 1, "_rows": F.count("*").over(Window.partitionBy(*keys))})


def holdout(df: DataFrame, fraction: float = 0.2, keys: Sequence[str] = KEY) -> DataFrame:
    """``role``: the last ``fraction`` of each series (rounded up) is ``test``, the rest ``train``; no shuffle of rows."""
    return positions(df, keys).withColumn("role", F.when(F.col("_pos") >= F.col("_rows") - F.ceil(F.col("_rows") * fraction), "test").otherwise("train")).drop("_pos", "_rows")


def walk_forward(first: datetime, last: datetime, train_days: int, test_days: int, step_days: int, min_train_days: int, purge_minutes: int = 0, embargo_minutes: int = 0, step: timedelta = timedelta(0)) -> list[tuple]:
    """``(fold, train_start, train_end, test_start, test_end)`` of walk-forward folds; with purge the train end comes earlier,
    with embargo the next fold starts ``embargo`` after a test at the earliest."""
    out, start = [], first + timedelta(days=min_train_days)
    while start + timedelta(days=test_days) <= last + step:
        end = start + timedelta(days=test_days)
        out.append((len(out), start - timedelta(days=train_days), start - timedelta(minutes=purge_minutes), start, end))
        start += timedelta(days=step_days)
        if purge_minutes or embargo_minutes:
            start = max(start, end + timedelta(minutes=embargo_minutes))
    return out


def in_folds(df: DataFrame, folds: Sequence[tuple], ts: str = "ts") -> DataFrame:
    """Rows with ``fold`` and ``role``, once for each fold they are in; from the first fold on that lacks either side none is left."""
    table = df.sparkSession.createDataFrame([(f, role, a, b) for f, x, y, z, w in folds for role, a, b in (("train", x, y), ("test", z, w))] or [(0, "", None, None)], "fold int, role string, _from timestamp, _to timestamp")
    out = df.join(F.broadcast(table), (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))).drop("_from", "_to")  # two rows for each fold
    sides = out.groupBy("fold").agg(F.count_distinct("role").alias("n")).where("n = 2")
    good = {r.fold for r in sides.collect()}
    whole = [f for f, *_ in folds if all(k in good for k in range(f + 1))]
    return out.where(F.col("fold").isin(whole)) if whole else out.where(F.lit(False))


def time_gaps(df: DataFrame) -> DataFrame:
    """``g``: the microseconds between neighbours of all distinct times; within each day, and then over the days' ends, so that no task
    holds all times."""
    t = df.select(F.unix_micros("ts").alias("t"), F.to_date("ts").alias("day")).distinct()
    inside = t.select((F.col("t") - F.lag("t").over(Window.partitionBy("day").orderBy("t"))).alias("g"))
    days = t.groupBy("day").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    across = days.select((F.col("a") - F.lag("b").over(Window.partitionBy(F.lit(0)).orderBy("day"))).alias("g"))  # one row a day
    return inside.unionByName(across).where("g is not null")


def walk_forward_split(df: DataFrame, train_days: int, test_days: int, step_days: int, min_train_days: int, purge_minutes: int | None = None, embargo_minutes: int = 0) -> DataFrame:
    """Walk-forward folds over all of ``df``; purged ones where ``purge_minutes`` is given."""
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = timedelta(0)
    if purge_minutes is not None:
        m = time_gaps(df).agg(F.median("g")).first()[0]
        step = timedelta(microseconds=m) if m and m > 0 else timedelta(minutes=1)
    folds = walk_forward(first, last, train_days, test_days, step_days, min_train_days, purge_minutes or 0, embargo_minutes, step) if first else []
    return in_folds(df, folds)


def purged_kfold(df: DataFrame, k: int, embargo_minutes: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Folds by row position: the test of fold ``i`` lies between ``trunc(i n / (k+1))`` and the next; its train part is all before,
    less the time windows, widened by the embargo, of this test and of every earlier one. A fold without train rows is left out,
    but its window still counts."""
    t = positions(df, keys).where(F.col("_rows") > k)
    bound = lambda i: F.floor(F.col("_rows") * F.lit(i) / (k + 1))
    fold = sum((F.when(F.col("_pos") >= bound(i), 1).otherwise(0) for i in range(1, k + 1)), F.lit(0)) - 1
    t = t.withColumn("_fold", fold)
    e = embargo_minutes * 60_000_000
    us = F.unix_micros("ts")
    windows = t.where("_fold >= 0").groupBy(*keys, F.col("_fold").alias("_w")).agg((F.min(us) - e).alias("_lo"), (F.max(us) + e).alias("_hi"))
    bars = windows.groupBy(*keys).agg(F.collect_list(F.struct("_w", "_lo", "_hi")).alias("_ws"))  # k entries for each series
    t = t.join(bars, list(keys))
    free = lambda f: ~F.exists("_ws", lambda w: (w["_w"] <= f) & (us >= w["_lo"]) & (us <= w["_hi"]))
    later = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (f > F.col("_fold")) & free(f))
    train = t.withColumn("fold", F.explode(later)).withColumn("role", F.lit("train"))
    some = train.select(*keys, "fold").distinct()
    test = t.where("_fold >= 0").withColumn("fold", F.col("_fold")).withColumn("role", F.lit("test")).join(some, [*keys, "fold"], "left_semi")
    return train.unionByName(test).select(*df.columns, "fold", "role")


def expanding(df: DataFrame, k: int, gap: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Expanding folds by position: tests of ``n div (k+1)`` rows at the end of the series, trains of all before less ``gap`` rows."""
    size = F.floor(F.col("_rows") / (k + 1))
    t = positions(df, keys).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("_rows") - size * (k - F.col("fold"))
    role = F.when((F.col("_pos") >= start) & (F.col("_pos") < start + size), "test").when(F.col("_pos") < start - gap, "train")
    return t.withColumn("role", role).where("role is not null").select(*df.columns, "fold", "role")


def hashed_order(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def class_ranks(df: DataFrame, y: str, key: str, seed: int, parts: int = 1024) -> DataFrame:
    """Adds ``_rank`` (from 1, in hashed order within each class) and ``_rows`` (the class's size). The hash's upper bits make ``parts`` parts,
    of which the sizes before each are summed, so no task holds a class."""
    t = df.withColumn("_hash", hashed_order(F.col(key), seed)).withColumn("_part", F.shiftright("_hash", 64 - (parts.bit_length() - 1)))
    ahead = Window.partitionBy(y).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy(y, "_part").agg(F.count("*").alias("_size"))
    sizes = sizes.select(F.col(y).alias("_y"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy(y)).alias("_rows"))
    t = t.withColumn("_own", F.row_number().over(Window.partitionBy(y, "_part").orderBy("_hash", key)))
    t = t.join(sizes, t[y].eqNullSafe(F.col("_y")) & (t["_part"] == F.col("_p")))
    return t.withColumn("_rank", F.col("_ahead") + F.col("_own")).select(*[t[c] for c in df.columns], "_rank", "_rows")


def stratified_holdout(df: DataFrame, y: str, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``role`` by hashed order within each class: sizes are exact, membership depends on ``key`` and ``seed`` only."""
    role = F.when(F.col("_rank") <= F.round(F.col("_rows") * fraction), "test").otherwise("train")
    return class_ranks(df, y, key, seed).withColumn("role", role).drop("_rank", "_rows")


def stratified_kfold(df: DataFrame, y: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` by hashed order within each class: sizes of a class differ by one row at the most."""
    return class_ranks(df, y, key, seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_rows")
