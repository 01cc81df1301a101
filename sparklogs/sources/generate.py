"""Generated rows, each a function of its number only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps

LEVELS = ("debug", "info", "warn", "error")
SERVICES = ("checkout", "auth", "payment", "inventory")
SPAN_MS = 30 * 86_400_000


def generated(rows: DataFrame, start: datetime) -> DataFrame:
    """Log rows for the ids in rows: 30 days, four levels, four services (uneven), user_id, region, retries."""
    i = F.col("id")
    level = F.array(*map(F.lit, LEVELS))[(i * 31 % 4).cast("int")]
    service = F.array(*map(F.lit, SERVICES))[(i * 17 % 7 % 4).cast("int")]
    attributes = F.to_json(F.struct((i % 5).alias("retries"), F.lit("eu-west").alias("region"), (i * 13 % 1000).cast("string").alias("user_id")))
    return rows.select(
        "id", F.timestamp_millis(F.lit(timestamps.millis(start)) + i * 7919 % SPAN_MS).alias("timestamp"), level.alias("level"), service.alias("service"),
        F.concat(F.lit("entry "), i.cast("string")).alias("message"), attributes.alias("attributes"),
    )


def generate(spark: SparkSession, n: int, start: datetime) -> DataFrame:
    return generated(spark.range(n), start)
