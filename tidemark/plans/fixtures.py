"""Series derived from the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timegrid import bars


class Inputs:
    """The tables of a folder, and series made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})

    def ticks(self) -> DataFrame:
        return self.table("events")

    def bars(self, seconds: int = 3600, symbol: str | None = None, label: str = "1h") -> DataFrame:
        who = F.lit(symbol) if symbol else F.col("event_type")
        return bars(self.ticks(), seconds, who, 100 + F.col("value") / 100, 1 + F.col("event_id") % 7, F.col("user_id") % 2 == 0, label=label)

    def bars_15m(self) -> DataFrame:
        return self.bars(900, "ALL", "15m")

    def bars_zero(self) -> DataFrame:
        hour = F.hour("ts")
        return self.bars().withColumns({"volume": F.when(hour % 7 == 0, 0.0).otherwise(F.col("volume")), "close": F.when(hour % 11 == 0, 0.0).otherwise(F.col("close"))})

    def deriv(self) -> DataFrame:
        by = Window.partitionBy("symbol", "interval").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        o = F.col("open")
        return self.bars().withColumns({"open_interest": F.sum("volume").over(by), "funding_rate": (F.col("close") - o) / o, "basis_annualized": (F.col("high") - F.col("low")) / F.col("close"), "liq_long": F.col("taker_buy_base"), "liq_short": F.col("volume") - F.col("taker_buy_base")})

    def joined(self) -> DataFrame:
        """Bars with derivatives, two levels of a book, an on-chain count and the price of another asset."""
        t, n = self.deriv(), F.col("number_of_trades")
        return t.withColumns({
            "lob_bid_L1": F.col("taker_buy_base"), "lob_ask_L1": F.col("volume") - F.col("taker_buy_base"), "lob_bid_price_1": F.col("close") - 1, "lob_bid_price_2": F.col("close") - 3, "lob_ask_price_1": F.col("close") + 2,
            "lob_bid_size_1": n.cast("double"), "lob_bid_size_2": F.lit(2.0), "lob_ask_size_1": n % 5 + 1.0, "lob_ask_price_2": F.col("close") + 5, "lob_ask_size_2": F.lit(3.0), "onch_mempool_count": F.when(n % 3 != 0, n.cast("double")), "ethbtc_close": F.col("high") + F.col("low"),
        })

    def gapped(self) -> DataFrame:
        """Bars of a minute whose close ``x`` is unknown for a long run of rows: up to 6,000, half of the series at most."""
        by = Window.partitionBy("symbol")
        t = self.bars(60, "ALL", "1m").withColumns({"n": F.row_number().over(by.orderBy("ts")), "c": F.count("*").over(by)})
        return t.withColumn("x", F.when(~F.col("n").between(30, 29 + F.least(F.lit(6000), F.floor(F.col("c") / 2))), F.col("close"))).drop("n", "c")

    def preds(self) -> DataFrame:
        """Predictions for the next hour, with their target and price."""
        by = Window.partitionBy("symbol", "interval").orderBy("ts")
        return self.bars().select("symbol", "interval", "ts", F.col("close").alias("last_price"), F.lead("close").over(by).alias("target"), F.col("open").alias("p_hat"), (F.col("number_of_trades") % 10 / 10).alias("prob")).where("target is not null")

    def scored(self) -> DataFrame:
        d = self.table("documents").select("doc_id", F.col("lang").alias("regime"), ((F.col("n_chars") % 997) / 997.0).alias("y_prob"))
        return self.table("labels").select("doc_id", F.col("quality").alias("y_true")).join(d, "doc_id")

    def drift(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp")).alias("is_current"))

    def hist(self) -> DataFrame:
        x = F.struct(F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"), F.col("l_quantity").cast("double").alias("size"))
        return self.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(x)).alias("hist"))

    def book(self, levels: int = 10) -> DataFrame:
        """Order-book snapshots by supplier and year, wide: ``lob_{side}_{price,size}_N``."""
        li = self.table("lineitem").select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber")
        sign = F.when(F.col("side") == "bid", -1).otherwise(1)
        n = F.row_number().over(Window.partitionBy("k", "y", "side").orderBy(F.col("price") * sign, "l_orderkey", "l_linenumber"))
        li = li.withColumn("n", n).where(F.col("n") <= levels)
        at = lambda side, what, i: F.max(F.when((F.col("side") == side) & (F.col("n") == i), F.col(what))).alias(f"lob_{side}_{what}_{i}")
        wide = li.groupBy("k", "y").agg(*[at(s, w, i) for s in ("bid", "ask") for w in ("price", "size") for i in range(1, levels + 1)])
        return wide.withColumn("close", F.coalesce("lob_bid_price_1", "lob_ask_price_1"))

    def payload(self) -> DataFrame:
        """Raw chart payloads, one a day and symbol: ``{"data": [[epoch, "close"], ...]}``."""
        point = F.array(F.unix_timestamp("ts").cast("string"), F.round("close", 4).cast("string"))
        days = self.bars().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(point)).alias("data"))
        text = F.concat(F.lit('{"data":['), F.array_join(F.transform("data", lambda p: F.concat(F.lit("["), p[0], F.lit(',"'), p[1], F.lit('"]'))), ","), F.lit("]}"))
        return days.select("symbol", "day", F.when(F.dayofmonth("day") % 10 == 0, F.lit('{"data": oops')).otherwise(text).alias("payload"))


BARS = """
bars AS (
  SELECT event_type AS symbol, '1h' AS "interval", CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS ts,
    arg_min(px, ts) AS open, max(px) AS high, min(px) AS low, arg_max(px, ts) AS close,
    CAST(sum(qty) AS DOUBLE) AS volume, sum(px * qty) AS quote_asset_volume, count(*) AS number_of_trades,
    CAST(sum(CASE WHEN tb THEN qty ELSE 0 END) AS DOUBLE) AS taker_buy_base, sum(CASE WHEN tb THEN px * qty ELSE 0 END) AS taker_buy_quote
  FROM (SELECT *, 100 + value / 100 AS px, CAST(1 + event_id % 7 AS DOUBLE) AS qty, user_id % 2 = 0 AS tb FROM events) GROUP BY ALL)"""
BARS_15M = """
bars_15m AS (
  SELECT 'ALL' AS symbol, '15m' AS "interval", CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS ts,
    arg_min(px, ts) AS open, max(px) AS high, min(px) AS low, arg_max(px, ts) AS close,
    CAST(sum(qty) AS DOUBLE) AS volume, sum(px * qty) AS quote_asset_volume, count(*) AS number_of_trades
  FROM (SELECT *, 100 + value / 100 AS px, CAST(1 + event_id % 7 AS DOUBLE) AS qty FROM events) GROUP BY ALL)"""
BARS_MINUTE = """
bars_min AS (SELECT 'ALL' AS symbol, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS ts, arg_max(100 + value / 100, ts) AS close FROM events GROUP BY ALL)"""
BARS_ZERO = """
bars_zero AS (SELECT * REPLACE (CASE WHEN (ts // 3600 % 24) % 7 = 0 THEN 0.0::DOUBLE ELSE volume END AS volume,
  CASE WHEN (ts // 3600 % 24) % 11 = 0 THEN 0.0::DOUBLE ELSE close END AS close) FROM bars)"""
DERIV = """
deriv AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts) AS open_interest, (close - open) / open AS funding_rate,
  (high - low) / close AS basis_annualized, taker_buy_base AS liq_long, volume - taker_buy_base AS liq_short FROM bars)"""
JOINED = """
joined AS (SELECT *, taker_buy_base AS lob_bid_L1, volume - taker_buy_base AS lob_ask_L1, close - 1 AS lob_bid_price_1, close - 3 AS lob_bid_price_2, close + 2 AS lob_ask_price_1,
  CAST(number_of_trades AS DOUBLE) AS lob_bid_size_1, 2.0::DOUBLE AS lob_bid_size_2, number_of_trades % 5 + 1.0::DOUBLE AS lob_ask_size_1, close + 5 AS lob_ask_price_2, 3.0::DOUBLE AS lob_ask_size_2,
  CASE WHEN number_of_trades % 3 <> 0 THEN CAST(number_of_trades AS DOUBLE) END AS onch_mempool_count, high + low AS ethbtc_close FROM deriv)"""
PREDS = """
preds AS (SELECT * FROM (SELECT symbol, "interval", ts, close AS last_price, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS target,
  open AS p_hat, (number_of_trades % 10) / 10.0::DOUBLE AS prob FROM bars) WHERE target IS NOT NULL)"""
SCORED = """
scored AS (SELECT l.doc_id, quality AS y_true, lang AS regime, CAST(n_chars % 997 AS DOUBLE) / 997 AS y_prob FROM labels l JOIN documents d USING (doc_id))"""
DRIFT = """
drift AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_shipdate >= TIMESTAMP '1998-07-01' AS is_current FROM lineitem)"""
HIST = """
hist AS (SELECT l_orderkey, ln(l_extendedprice / l_quantity) AS rate, CAST(l_quantity AS DOUBLE) AS size FROM lineitem)"""
BOOK = """
levels AS (SELECT * FROM (SELECT l_suppkey AS k, year(l_shipdate) AS y, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    ln(l_extendedprice / l_quantity) AS price, l_quantity AS size,
    row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate), l_linestatus ORDER BY ln(l_extendedprice / l_quantity) * CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END, l_orderkey, l_linenumber) AS n
  FROM lineitem) WHERE n <= 10),
snaps AS (SELECT k, y, coalesce(max(CASE WHEN side = 'bid' AND n = 1 THEN price END), max(CASE WHEN side = 'ask' AND n = 1 THEN price END)) AS close,
  max(CASE WHEN side = 'bid' AND n = 1 THEN price END) AS bid1, max(CASE WHEN side = 'ask' AND n = 1 THEN price END) AS ask1,
  coalesce(sum(CASE WHEN side = 'bid' THEN size END), 0) AS bids, coalesce(sum(CASE WHEN side = 'ask' THEN size END), 0) AS asks FROM levels GROUP BY k, y)"""
