"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where it is unset and Spark runs on one machine (as in tests), a folder of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", folder)
    return folder.rstrip("/")


#: The tables of the scopes that are open in this thread, the innermost last.
_scopes = threading.local()


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors. It stays until that folder is cleaned, or
    until the :func:`scratch` that it was written in ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_scopes, "open", None):
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of a scope."""

    def __init__(self, spark: SparkSession):
        self.spark, self.result = spark, None

    def keep(self, df: DataFrame, name: str = "part") -> DataFrame:
        """``df``, written as a table that outlives the scope; what it was made of may go then."""
        scopes = _scopes.open
        mine = scopes.pop()
        try:
            return written(df, name)
        finally:
            scopes.append(mine)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables written inside are removed at the end, after an error too. What is to last must be written by ``keep``: a DataFrame that was
    made inside and not written reads tables that are gone."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield Scratch(spark)
    finally:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        for path in _scopes.open.pop():
            place = hadoop.Path(path)
            place.getFileSystem(conf).delete(place, True)
