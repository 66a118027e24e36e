"""A training corpus from ``documents``: known languages, no copies, mixed sources, token ids.

Every stage takes each row by itself, whatever its ``doc_id``: null and repeated ids are no special case, and columns of any other
names pass through. Null texts are empty, and go in the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import token_digests
from tidemark.llm.common import in_small_batches, written
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.language_id import keep_languages
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without letters (null texts too), or whose language the model tells with a score below a half, go. Without any
    labelled row all go."""
    return keep_languages(in_small_batches(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one of each group of equal texts stays, the longest, then that of the smallest id (a null one last)."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies (shingles of five words, similarity of 0.8 or more) the one of the smallest id stays."""
    return drop_near_copies(in_small_batches(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it, twice at the most; a null source is a source of its own."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ``doc_id``, token ids, their number and digest, and the digest of what they decode to, for each row."""
    return token_digests(in_small_batches(docs), with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: The models, the fingerprints' hash and the token ranks are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
