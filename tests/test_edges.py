"""Values on an edge, where the last digit decides: as DuckDB's aggregates decide it."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import drift

#: The largest is the mean and two deviations, but for rounding.
SIZES = [
    [1, 6, 6, 13, 11, 19, 8, 6, 23, 29],
    [1, 1, 2, 7, 9, 5, 9, 8, 9, 15],
    [2, 5, 9, 1, 5, 10, 9, 10, 9, 16],
    [1, 1, 2, 1, 1, 4, 7, 13, 5, 11],
    [37, 43, 32, 32, 33, 27, 43, 32, 39, 50],
    [1, 2, 5, 5, 5, 7, 13, 15, 8, 5],
    [1, 1, 1, 1, 50],
    [1, 1, 1, 1, 1, 50],
]


def test_walls_at_two_deviations(spark):
    df = spark.createDataFrame([(i, list(map(float, s))) for i, s in enumerate(SIZES)], "i int, s array<double>")
    levels = F.transform("s", lambda x, i: F.struct((i + 1).alias("level"), (100.0 + i).alias("price"), x.alias("size")))
    got = {r.i: r.x is not None for r in df.select("i", arrays.wall(levels, F.lit(100.0))["size_rel"].alias("x")).collect()}
    con = duckdb.connect()
    over = lambda s: con.execute("SELECT max(x) > avg(x) + 2 * stddev_pop(x) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [s]).fetchone()[0]
    assert got == {i: over(s) for i, s in enumerate(SIZES)} and len(set(got.values())) == 2


@pytest.mark.parametrize("n", [8840, 997, 31])
def test_cuts_between_equal_values_are_these(spark, n):
    """Every hundredth in turn, so that a quantile mostly lies between two equal values."""
    rows = [(i % 11 / 100, j) for j in (False, True) for i in range(n + 400 * j)]
    counts = drift.by_value(drift.unpivoted_counts(spark.createDataFrame(rows, "x double, is_current boolean").transform(lambda d: drift.unpivoted(d, ["x"]))))
    cuts = drift.reference_cuts(counts, 10).first().cuts
    reference = np.array([x for x, now in rows if not now])
    con = duckdb.connect()
    want = con.execute("SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [reference.tolist()]).fetchone()[0]
    assert cuts == list(dict.fromkeys(want))
