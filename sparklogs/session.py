"""The session settings that results depend on, and those that suit a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere; the last of duplicate JSON keys wins; a write replaces only the partitions that it brings.
NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepared(spark: SparkSession) -> SparkSession:
    """spark with the settings in NEEDED."""
    for key, value in NEEDED.items():
        spark.conf.set(key, value)
    return spark


def create(name: str = "sparklogs", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true")
    for key, value in (NEEDED | conf).items():
        builder = builder.config(key, value)
    return prepared(builder.getOrCreate())
