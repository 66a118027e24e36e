"""Queries that run the streaming jobs over the ``events`` table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import VersionedTable
from ..streaming import jobs, keyed, run
from .fixtures import BARS, Inputs
from .registry import query

#: What the watermark has passed when the input ends: an hour before the last event, in whole milliseconds.
MARK = "(SELECT floor(epoch_us(max(ts)) // 1000 / 1000.0 - 3600) FROM events)"


def ticks(s: Inputs) -> DataFrame:
    return run.table_stream(s.spark, s.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str2_bars_stream", f"SELECT symbol, ts, open, high, low, close, volume, number_of_trades FROM bars WHERE ts + 3600 <= {MARK}", "open high low close volume", "number_of_trades", BARS)
def bars(s: Inputs) -> DataFrame:
    return run.drained(jobs.bars_stream(ticks(s), "1 hour", "1 hour", F.col("event_type"), 100 + F.col("value") / 100, 1 + F.col("event_id") % 7))


@query("str4_hysteresis_stream", f"""SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(coalesce(last_value(CASE WHEN value >= 20 THEN 1 WHEN value <= 5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts), 0) AS DOUBLE) AS out
 FROM events WHERE epoch_us(ts) < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) * 1000""", "out")
def hysteresis(s: Inputs) -> DataFrame:
    t = ticks(s).select(F.col("event_type").alias("symbol"), "ts", "value")
    return run.drained(keyed.in_time_order(t, keyed.hysteresis_step(20.0, 15.0), "value", "1 hour"))


@query("str4_ema_stream", f"""WITH RECURSIVE v AS (SELECT event_type AS s, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events
 WHERE epoch_us(ts) < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) * 1000),
e AS (SELECT s, ts, n, value AS out FROM v WHERE n = 1 UNION ALL SELECT v.s, v.ts, v.n, e.out * 9 / 11 + v.value * 2 / 11 FROM e JOIN v ON v.s = e.s AND v.n = e.n + 1)
SELECT s AS symbol, CAST(floor(epoch(max(ts))) AS BIGINT) AS ts, count(*) AS n, arg_max(out, ts) AS out FROM e GROUP BY s, n % 100""", "out", "n")
def averages(s: Inputs) -> DataFrame:
    """The last of each hundredth of a type's averages: a row depends on all before it."""
    t = ticks(s).select(F.col("event_type").alias("symbol"), "ts", "value")
    out = run.drained(keyed.in_time_order(t, keyed.ema_step(10), "value", "1 hour"))
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    return out.withColumn("n", n).groupBy("symbol", F.col("n") % 100).agg(F.max("ts").alias("ts"), F.count("*").alias("n"), F.max_by("out", "ts").alias("out")).select("symbol", "ts", "n", "out")


#: Messages made of events: some broken, some without a count, some without a histogram, with recommended fees in every third.
MESSAGES = """m AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 AS bucket, epoch_us(ts) AS us, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS DOUBLE) END AS n, event_id + 0.5::DOUBLE AS vsize,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS fee, CASE WHEN event_id % 7 <> 0 THEN user_id % 9 + 1 END AS a, event_id % 5 + 1 AS b FROM events WHERE event_id % 5 <> 0)"""
SNAPSHOT = """{last}(n, us) FILTER (n IS NOT NULL) AS onch_mempool_count, {last}(vsize, us) AS onch_mempool_vsize_vB, CAST({last}(b * 1000, us) AS DOUBLE) AS onch_mempool_total_fee_sat, {last}(fee, us) FILTER (fee IS NOT NULL) AS onch_fee_fast_satvb,
 {last}(fee - 1, us) FILTER (fee IS NOT NULL) AS onch_fee_30m_satvb, {last}(fee - 2, us) FILTER (fee IS NOT NULL) AS onch_fee_60m_satvb, {last}(fee - 3, us) FILTER (fee IS NOT NULL) AS onch_fee_min_satvb,
 {last}((a + 2 * b + 15) / (a + b + 3), us) FILTER (a IS NOT NULL) AS onch_fee_wavg_satvb, {last}(CASE WHEN 2 * a >= a + b + 3 THEN 1.0 WHEN 2 * (a + b) >= a + b + 3 THEN 2.0 ELSE 5.0 END, us) FILTER (a IS NOT NULL) AS onch_fee_p50_satvb,
 {last}(CASE WHEN a >= 0.9 * (a + b + 3) THEN 1.0 WHEN a + b >= 0.9 * (a + b + 3) THEN 2.0 ELSE 5.0 END, us) FILTER (a IS NOT NULL) AS onch_fee_p90_satvb""".format(last="arg_max")
SNAPSHOT_COLUMNS = "onch_mempool_count onch_mempool_vsize_vB onch_mempool_total_fee_sat onch_fee_fast_satvb onch_fee_30m_satvb onch_fee_60m_satvb onch_fee_min_satvb onch_fee_wavg_satvb onch_fee_p50_satvb onch_fee_p90_satvb"


def messages(s: Inputs) -> DataFrame:
    text = """CASE WHEN event_id % 5 = 0 THEN '{broken' ELSE concat('{', CASE WHEN event_id % 4 <> 0 THEN concat('"count": ', user_id, ', ') ELSE '' END, '"vsize": ', event_id, '.5, "total_fee": ', (event_id % 5 + 1) * 1000,
      CASE WHEN event_id % 3 = 0 THEN concat(', "fastestFee": ', event_id % 50, ', "halfHourFee": ', event_id % 50 - 1, ', "hourFee": ', event_id % 50 - 2, ', "economyFee": ', event_id % 50 - 3) ELSE '' END,
      CASE WHEN event_id % 7 <> 0 THEN concat(', "fee_histogram": [[1, ', user_id % 9 + 1, '], [2, ', event_id % 5 + 1, '], [5, 3]]') ELSE '' END, '}') END"""
    return ticks(s).select(F.col("ts").alias("event_time"), F.expr(text).alias("payload"))


@query("str1_snapshot_stream", f"SELECT bucket AS ts, {SNAPSHOT} FROM m GROUP BY bucket HAVING bucket + 900 <= (SELECT floor(epoch_us(max(ts)) // 1000 / 1000.0 - 600) FROM events)", SNAPSHOT_COLUMNS, ctes=MESSAGES)
def snapshots(s: Inputs) -> DataFrame:
    return run.drained(jobs.snapshot_stream(messages(s)))


@query("str1_snk2_snapshot_table", f"SELECT * REPLACE (CASE WHEN onch_mempool_count IS NULL THEN bucket_height ELSE onch_mempool_count END AS onch_mempool_count) FROM (SELECT bucket AS ts, {SNAPSHOT}, CAST(bucket % 1000 AS DOUBLE) AS bucket_height FROM m GROUP BY bucket)".replace("bucket_height", "onch_height"), SNAPSHOT_COLUMNS + " onch_height", ctes=MESSAGES)
def stored(s: Inputs) -> DataFrame:
    """The stream of messages over a stored grid that has a height and a count for each bucket: the height stays, the count where no message has one."""
    columns = ["onch_height", *SNAPSHOT_COLUMNS.split()]
    grid = ticks_now(s).select(F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias("ts")).distinct()
    height = (F.unix_timestamp("ts") % 1000).cast("double")
    grid = grid.select("ts", *[(height if c in ("onch_height", "onch_mempool_count") else F.lit(None).cast("double")).alias(c) for c in columns])
    place = f"{run.shared_folder(s.spark)}/grid-{uuid.uuid4().hex}"
    table = VersionedTable(s.spark, f"{place}/table", grid.schema, F.date_format("ts", "yyyy-MM-dd"))
    table.change(grid, lambda _, rows: rows, "grid", 0)
    run.drained_batches(messages(s), jobs.snapshot_upserts(table), place)
    return table.read()


def ticks_now(s: Inputs) -> DataFrame:
    return s.ticks().where("event_id % 5 <> 0")


@query("str3_landing_stream", "SELECT user_id AS symbol, min(epoch_us(ts) // 1000) AS open_time, arg_min(value, ts) AS close FROM events GROUP BY user_id", "close")
def landed(s: Inputs) -> DataFrame:
    place = f"{run.shared_folder(s.spark)}/landing-{uuid.uuid4().hex}"
    schema = "symbol long, open_time long, close double"
    s.spark.createDataFrame([], schema).write.parquet(f"{place}/target")
    read = lambda: s.spark.read.schema(schema).parquet(f"{place}/target")
    rows = ticks(s).select(F.col("user_id").alias("symbol"), F.unix_millis("ts").alias("open_time"), F.col("value").alias("close"), F.unix_micros("ts").alias("arrival"))
    run.drained_batches(rows, jobs.landing(read, lambda d: d.write.mode("append").parquet(f"{place}/target"), ["symbol"], "arrival"), place)
    return read()


@query("str3_landing_once", "SELECT user_id AS symbol, min(epoch_us(ts) // 1000) AS open_time, arg_min(value, ts) AS close FROM events GROUP BY user_id", "close")
def landed_once(s: Inputs) -> DataFrame:
    """The same into a versioned table, after a watermark's deduplication; the second run of the batch changes nothing."""
    place = f"{run.shared_folder(s.spark)}/once-{uuid.uuid4().hex}"
    schema = s.spark.createDataFrame([], "symbol long, open_time long, close double").schema
    table = VersionedTable(s.spark, f"{place}/table", schema, F.col("symbol") % 8)
    rows = jobs.deduplicated(ticks(s), ["event_id"], "1 hour").select(F.col("user_id").alias("symbol"), F.unix_millis("ts").alias("open_time"), F.col("value").alias("close"), F.unix_micros("ts").alias("arrival"))
    land = jobs.landing_once(table, ["symbol"], "arrival")

    def twice(df: DataFrame, number: int) -> None:
        land(df, number)
        land(df, number)

    run.drained_batches(rows, twice, place)
    return table.read()


@query("str5_scoring_stream", """SELECT e.event_type AS symbol, e.event_id * 1000 AS target_time_ms, e.value * 2 AS p_hat, CASE WHEN e.event_id % 3 = 0 THEN e.value END AS y_true_hat, CASE WHEN e.event_id % 3 = 0 THEN abs(e.value * 2 - e.value) END AS abs_error FROM events e""", "p_hat y_true_hat abs_error")
def scored(s: Inputs) -> DataFrame:
    place = f"{run.shared_folder(s.spark)}/scores-{uuid.uuid4().hex}"
    prices = s.ticks().where("event_id % 3 = 0").select(F.col("event_type").alias("symbol"), (F.col("event_id") * 1000).alias("open_time"), F.col("value").alias("close"))
    rows = ticks(s).select(F.col("event_type").alias("symbol"), (F.col("event_id") * 1000).alias("target_time_ms"), "value")
    score = lambda d: d.select("symbol", "target_time_ms", (F.col("value") * 2).alias("p_hat"), F.lit(None).cast("double").alias("y_true_hat"), F.lit(None).cast("double").alias("abs_error"))
    run.drained_batches(rows, jobs.scoring(score, lambda: prices, lambda d: d.write.mode("append").parquet(f"{place}/out")), place)
    return s.spark.read.parquet(f"{place}/out")
