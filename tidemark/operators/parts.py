"""Running aggregates over long series that many tasks share.

A window over a series puts the whole series into one task. Here the rows are dealt by range instead, so a series lies in consecutive
parts; each part aggregates its own rows, and what the parts before it add up to (one row for a part and a series) is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: An aggregate by name: the function of a window or a group, and how the values of two stretches make that of both.
AGGREGATES = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def in_parts(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df``, written, with ``_part``: rows lie in it by ``keys`` and ``order`` (nulls first), in ``parts`` parts of about the same
    size (by default as many as a shuffle has). Rows that repeat all these columns may be told apart, so no key makes a part overfull."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, "_row").drop("_row")
    return written(dealt.withColumn("_part", F.spark_partition_id()), "parts")


def running(df: DataFrame, keys: list[str], order: list[str], backwards: bool = False, before: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """``df`` (with ``_part``, rows of a series in consecutive parts) with a column for each of ``values``: the aggregate of that name
    over the rows of the series up to this one; ``backwards``: from this one on; ``before``: without this one.

    ``order`` tells the rows of a series apart, else equals are taken in any order. ``keys`` are not null. No task gets more than
    one part of a series, or more than one row of each part of it. ``df`` is read twice.
    """
    turn = (lambda c: F.col(c).desc()) if backwards else F.col
    here = Window.partitionBy("_part", *keys).orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ahead = Window.partitionBy(*keys).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    end = lambda value: (F.min_by if backwards else F.max_by)(value, F.when(value.isNotNull(), F.struct(*order)))
    whole_part = lambda kind, value: end(value) if kind == "last" else AGGREGATES[kind][0](value)
    each = df.groupBy("_part", *keys).agg(*[whole_part(kind, value).alias(f"_{name}") for name, (kind, value) in values.items()])
    carry = each.select("_part", *keys, *[AGGREGATES[kind][0](f"_{name}").over(ahead).alias(f"_{name}") for name, (kind, _) in values.items()])
    local = df.select("*", *[AGGREGATES[kind][0](value).over(here).alias(name) for name, (kind, value) in values.items()])
    joined = local.join(carry, ["_part", *keys])
    whole = {name: F.when(F.col(f"_{name}").isNull(), F.col(name)).when(F.col(name).isNull(), F.col(f"_{name}")).otherwise(AGGREGATES[kind][1](F.col(f"_{name}"), F.col(name))) for name, (kind, _) in values.items()}
    return joined.withColumns(whole).select(*df.columns, *values)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """``df`` with ``_part`` and the number of each row in its series, from 1, as :func:`in_parts` and :func:`running` make them."""
    return running(in_parts(df, keys, order, parts), keys, order, **{name: ("sum", F.lit(1).cast("long"))})
