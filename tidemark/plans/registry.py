"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, small ones to nine or twelve, times as epoch seconds: what both engines give alike."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            x = F.col(f.name).cast("double")
            out[f.name] = F.when(F.abs(x) >= 1e-2, F.round(x, 6)).when(F.abs(x) >= 1e-5, F.round(x, 9)).otherwise(F.round(x, 12))
        elif isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.unix_timestamp(f.name)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out)


def query(name: str, sql: str = "", doubles: str = "", longs: str = "", ctes: str = "") -> Callable:
    """Registers a function of :class:`Inputs`. ``sql`` is its twin, after the common tables ``ctes``; its columns ``doubles`` are
    rounded as in :func:`plain`, and ``longs`` cast."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain(f(Inputs(spark, folder)))
        if sql:
            replaced = [f"CASE WHEN abs({c}) >= 1e-2 THEN round({c}, 6) WHEN abs({c}) >= 1e-5 THEN round({c}, 9) ELSE round({c}, 12) END + 0.0::DOUBLE AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
            ORACLES[name] = (f"WITH RECURSIVE {ctes}\n" if ctes else "") + f"SELECT {star} FROM (\n{sql.strip()}\n)"
        return f

    return add
