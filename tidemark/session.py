"""The session that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONVENTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the engine's conventions; ``conf`` adds to them."""
    return SparkSession.builder.appName(app).config(map=CONVENTIONS | conf).getOrCreate()
