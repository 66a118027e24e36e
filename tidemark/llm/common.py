"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written as written

#: ASCII white space, as every contract of this package splits words on it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, for whose session Arrow batches are 1,000 rows unless they have been set: texts are long, and a Python worker holds
    whole batches."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return docs


def id_text(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` as text, for Python: pandas would turn integers among nulls into floats; with ``columns``."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *columns)


def id_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def count_words(text: Column) -> Column:
    """Number of words; null counts as no word."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def one_of_each(docs: DataFrame, keep: DataFrame, version: Column, *order: Column) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and ``version`` are in ``keep`` (columns of these names, no pair twice), one for each pair: the first by
    ``order``. Join and window share one exchange of the rows, as both go by the same two columns, which are never null."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # no number is empty
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), id_.alias("_tm_id"), version.alias("_tm_version"))
    met = d.join(keep.select(id_.alias("_tm_id"), F.col("version").alias("_tm_version")), ["_tm_id", "_tm_version"], "left_semi")
    by = Window.partitionBy("_tm_id", "_tm_version").orderBy(*(order or [F.lit(0)]))
    return met.withColumn("_tm_one", F.row_number().over(by)).where("_tm_one = 1").select("d.*")


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int | None = None, parts: int = 200) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``; ``weight``: how many of ``rows`` have it).

    Keys that hold over 1/``parts`` of all rows (of a shuffle partition's share, if that is less), of which there are fewer than that
    number, are broadcast, so their rows stay where they are; the others meet by a shuffle. ``rows`` is read twice, and counted
    unless ``total`` is given: pass a written table.
    """
    parts = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = (rows.count() if total is None else total) // parts
    hot = F.broadcast(table.where(F.col(weight) > limit))
    cool = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= limit), key)
    return rows.join(hot, key).unionByName(cool)
