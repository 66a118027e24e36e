"""Reading prices and other series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean, utc_timestamp
from ..operators.timegrid import resample

KLINE = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_asset_volume double, number_of_trades bigint, taker_buy_base double, taker_buy_quote double"


def price_scan(prices: DataFrame, symbol: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Candles of a symbol between two times (both included): plain comparisons, so they reach the scan. ``open_time`` becomes ``ts``;
    other columns stay."""
    out = prices.where(F.col("symbol") == symbol)
    if start_ms is not None:
        out = out.where(F.col("open_time") >= start_ms)
    if end_ms is not None:
        out = out.where(F.col("open_time") <= end_ms)
    return clean(out.withColumn("ts", F.timestamp_millis("open_time")).drop("open_time", "close_time"))


def file_scan(spark: SparkSession, path: str, time: str = "timestamp") -> DataFrame:
    """Parquet by suffix, else CSV with a header; ``time`` is parsed, and null where it cannot be."""
    df = spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else spark.read.option("header", True).csv(path)
    return clean(df.withColumn(time, utc_timestamp(F.col(time)))) if dict(df.dtypes).get(time) == "string" else clean(df)


def klines(rows: DataFrame, symbol: str, interval: str) -> DataFrame:
    """Typed candles from ``k``, arrays of eleven texts in the exchange's order."""
    fields = [f.split() for f in KLINE.split(", ")]
    typed = [F.get("k", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)]
    return rows.select(*typed, F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), *[c for c in rows.columns if c != "k"])


def next_start(prices: DataFrame, now_ms: int, lookback_ms: int) -> DataFrame:
    """``symbol, start_ms, due``: where the next load of each symbol begins, and whether anything is left to load."""
    start = F.greatest(F.max("open_time") + 1, F.lit(now_ms - lookback_ms))
    return prices.groupBy("symbol").agg(start.alias("start_ms")).withColumn("due", F.col("start_ms") < now_ms)


def flows(inflow: DataFrame, outflow: DataFrame, seconds: int = 3600) -> DataFrame:
    """Exchange flows (``t``, ``v``) outer-joined on time, their difference, summed into right-labelled buckets (null without values)."""
    both = inflow.select("t", F.col("v").alias("inflow")).join(outflow.select("t", F.col("v").alias("outflow")), "t", "full_outer")
    both = both.select(F.lit("all").alias("symbol"), F.col("t").alias("ts"), F.col("inflow").alias("onch_inflow"), F.col("outflow").alias("onch_outflow"), (F.col("inflow") - F.col("outflow")).alias("onch_netflow"))
    return resample(both, seconds, {c: F.sum(c) for c in ("onch_inflow", "onch_outflow", "onch_netflow")})


def transfers(payloads: DataFrame, seconds: int = 3600) -> DataFrame:
    """Count and sum of transfers by bucket from ``transactions``, arrays of ``(ts, usd)``; a null amount is 0."""
    t = payloads.select(F.explode("transactions").alias("t")).select(F.lit("all").alias("symbol"), "t.ts", F.coalesce("t.usd", F.lit(0.0)).alias("usd"))
    return resample(t, seconds, {"count": F.count("*"), "usd": F.sum("usd")}, empty={"count": 0, "usd": 0.0})


def cached_span(df: DataFrame, folder: str, source: str, span: str) -> DataFrame:
    """``df`` once materialised as Parquet under its source and span; later calls read that."""
    spark, path = df.sparkSession, f"{folder}/source={source}/span={span}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
