"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, attach, one_of_each, written


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256))


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    ``add`` puts a batch of documents against it by a sort-merge anti-join, tells for each document which one stays, and appends
    the batch's digests with their counts. The table (``digest, seq, batch, keep_id, n``: one row for each digest of each batch) is
    made empty at first; the bucketed side is never shuffled. With ``path`` it lies in that folder, and another session, whose catalog
    need not know it, goes on from there; without, it is a catalog table in the warehouse.

    Texts are equal when they are identical without ASCII white space; null counts as empty. Of equal texts
    in one batch the one with the most code points stays, then the smallest ``doc_id`` (a null one last);
    a digest of an earlier batch keeps its earlier document. Rows that repeat both text and ``doc_id`` are told
    apart by their order, so that one stays. Other columns are ignored; an empty batch gives an empty result. A batch that is added again
    under the same name (a retry) gives the same answers, and is appended only if it was not before.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            place = f"LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, seq BIGINT, batch STRING, keep_id BIGINT, n BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {place}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self, before: int | None = None) -> DataFrame:
        """``digest, keep_id, n``: each digest with the document that stays and its number of documents, over the batches ``before`` one."""
        rows = self.table() if before is None else self.table().where(F.col("seq") < before)
        return rows.groupBy("digest").agg(F.min_by("keep_id", "seq").alias("keep_id"), F.sum("n").alias("n"))

    def place(self, batch: str) -> tuple[int, bool]:
        """The number of ``batch``, and whether it has been appended."""
        mine, last = self.table().agg(F.min(F.when(F.col("batch") == batch, F.col("seq"))), F.max("seq")).first()
        return (mine, True) if mine is not None else ((last or 0) + 1, False)

    def append(self, new: DataFrame) -> None:
        (
            new.select("digest", "seq", "batch", "keep_id", "n")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """``doc_id, row, keep_id, group_size, kept, digest`` for each row of ``docs``; ``group_size``: equal texts up to this batch."""
        batch = batch or uuid.uuid4().hex
        seq, done = self.place(batch)
        size = F.char_length(F.coalesce(F.col("text"), F.lit("")))
        rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest"), size.alias("size")), "digests")
        order = F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
        best = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        best = written(best.select("digest", F.col("first.d").alias("keep_id"), F.col("first.r").alias("keep_row"), "n"), "groups")
        known = self.groups(seq)
        new = best.join(known.hint("merge"), "digest", "left_anti").withColumn("group_size", F.col("n"))
        seen = best.drop("keep_id").join(known.withColumnRenamed("n", "before").hint("merge"), "digest")
        seen = seen.select("digest", "keep_id", F.lit(None).cast("long").alias("keep_row"), "n", (F.col("n") + F.col("before")).alias("group_size"))
        groups = written(new.unionByName(seen), "decided")
        if not done:
            self.append(groups.withColumns({"seq": F.lit(seq).cast("long"), "batch": F.lit(batch)}))
        out = attach(rows.drop("size"), groups, "digest", "n")
        return out.select("doc_id", "row", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest")


def added(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """``docs`` added to ``index``, or to an empty one that lasts no longer."""
    own = index or DigestIndex(docs.sparkSession)
    out = own.add(docs, batch)
    if index is None:
        own.drop()
    return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    out = added(docs, index, batch)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns, once each (of rows that repeat text and ``doc_id`` the longest)."""
    kept = added(docs, index, batch).where("kept").select("doc_id", F.col("digest").alias("version"))
    return one_of_each(docs, kept, digest_of(F.col("text")), F.desc(F.char_length("d.text")))
