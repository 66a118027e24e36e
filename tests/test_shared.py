from pathlib import Path

import pytest

from tidemark.sources.shared import scratch, written


def place(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = written(spark.range(3), "before")
    with scratch(spark) as outer:
        a = written(spark.range(5), "a")
        with scratch(spark) as inner:
            b = written(a.where("id > 1"), "b")
            kept = inner.keep(b.where("id > 2"), "kept")
            gone = place(b)
        assert not gone.exists() and kept.count() == 2 and a.count() == 5
        out = outer.keep(kept, "out")
        places = [place(a), place(kept)]
    assert not any(p.exists() for p in places) and out.count() == 2 and before.count() == 3


def test_scratch_goes_after_an_error(spark):
    with pytest.raises(KeyError), scratch(spark):
        a = place(written(spark.range(5), "a"))
        raise KeyError
    assert not a.exists()
