"""Snapshots parse each text once, and stored grids have a file for a partition that a batch changes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import payloads
from tidemark.sources.versions import VersionedTable

START = datetime(2024, 1, 1)


def test_a_payload_is_parsed_once(spark):
    text = '{"count": 3, "vsize": 7.5, "fastestFee": 9, "minimumFee": "2", "fee_histogram": [[5, 1], [1, 2], [2, 3], ["x", 4], [3, -1]]}'
    df = spark.createDataFrame([("a", START, text), ("b", START, "{oops"), ("c", START, '{"fee_histogram": {"bins": [4, 1], "counts": [1, 9, 9]}}')], "symbol string, fetched_at timestamp, payload string")
    out = payloads.snapshot(df)
    assert str(out._jdf.queryExecution().optimizedPlan()).count("parseJson") == 1
    got = {r.symbol: r for r in out.collect()}
    assert got["a"].onch_mempool_count == 3 and got["a"].onch_fee_min_satvb == 2 and got["a"].onch_fee_wavg_satvb == pytest.approx(13 / 6)
    assert (got["a"].onch_fee_p50_satvb, got["a"].onch_fee_p90_satvb) == (2, 5) and got["c"].onch_fee_p90_satvb == 1 and got["b"].onch_fee_wavg_satvb is None


def test_a_change_writes_a_file_for_each_partition(spark, tmp_path):
    rows = [(START + timedelta(hours=i), float(i)) for i in range(24 * 30)]
    df = spark.createDataFrame(rows, "ts timestamp, x double").repartition(4, "x")
    table = VersionedTable(spark, f"file://{tmp_path}/t", df.schema, F.date_format("ts", "yyyy-MM-dd"))
    table.change(df, lambda _, new: new)
    assert len(list(tmp_path.rglob("*.parquet"))) == 30 and sorted((r.ts, r.x) for r in table.read().collect()) == rows
