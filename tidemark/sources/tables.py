"""Table maintenance without a table format: each operator gives the new version of a table, to be written beside the old one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timegrid import keep_last


def insert_or_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Rows of ``batch`` to append: the first arrival for each key that ``target`` lacks."""
    by = Window.partitionBy(*keys).orderBy(arrival)
    first = batch.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", arrival)
    return first.join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], updates: Sequence[str], arrival: str) -> DataFrame:
    """``target`` with the columns ``updates`` of the last arrival for each key; its other columns stay, new keys come in."""
    last = keep_last(batch, keys, arrival).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in updates], F.lit(True).alias("_hit"))
    both = target.join(last, list(keys), "full_outer")
    out = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in updates}
    return both.withColumns(out).select(*target.columns)


def migrate(legacy: DataFrame, schema: Mapping[str, str], renames: Mapping[str, str], keys: Sequence[str], arrival: str) -> DataFrame:
    """Rows of an older table under ``schema`` (name to type): renamed columns, null for missing ones, the first row for each key."""
    have = legacy.withColumnsRenamed({a: b for a, b in renames.items() if a in legacy.columns and b not in legacy.columns})
    by = Window.partitionBy(*keys).orderBy(arrival)
    have = have.withColumn("_n", F.row_number().over(by)).where("_n = 1")
    return have.select(*[(F.col(c) if c in have.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def retained(df: DataFrame, time: str | None, now_ms: int, keep_ms: int, required: str | None = None) -> DataFrame:
    """Rows newer than ``now - keep`` and with ``required`` filled; without a time column only the latter rule holds."""
    out = df.where(F.col(time) > now_ms - keep_ms) if time and time in df.columns else df
    return out.where(F.col(required).isNotNull()) if required else out


def deleted_counts(tables: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``table, deleted`` from pairs of old and new versions."""
    parts = [old.agg(F.count("*").alias("a")).crossJoin(new.agg(F.count("*").alias("b"))).select(F.lit(n).alias("table"), (F.col("a") - F.col("b")).alias("deleted")) for n, (old, new) in tables.items()]  # two single rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_rows(df: DataFrame, integers: Sequence[str]) -> DataFrame:
    """Rows of the on-chain grid as they are stored: seconds for times, half-even rounding of integer columns."""
    return df.withColumn("ts_utc", F.unix_timestamp("ts")).withColumns({c: F.bround(F.col(c), 0).cast("long") for c in integers}).drop("ts")


def overwrite_range(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replaces the partitions that ``df`` has rows for, all-null rows included, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the columns of both."""
    return old.unionByName(new, allowMissingColumns=True)


def write_features(df: DataFrame, path: str) -> None:
    """Features by symbol as Parquet, or CSV where the path says so."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_run(folder: str, run_id: str, tables: Mapping[str, DataFrame]) -> None:
    """The outputs of a run under ``name/run_id=...``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")


def write_cv_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
