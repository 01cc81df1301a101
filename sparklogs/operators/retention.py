"""Retention: whole date partitions go, the cutoff's own partition is rewritten."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps
from ..sources import store

DAYS = 30


def cutoff(as_of: datetime, days: int | None = None) -> datetime:
    return as_of - timedelta(days=days or DAYS)


def kept(logs: DataFrame, edge: datetime) -> DataFrame:
    return logs.where(F.col("timestamp") >= timestamps.literal(edge))


def deleted_by_day(logs: DataFrame, edge: datetime) -> DataFrame:
    gone = logs.where(F.col("timestamp") < timestamps.literal(edge))
    return gone.groupBy(F.to_date("timestamp").alias("dt")).agg(F.count("*").alias("deleted"))


def drop_before(spark, path: str, edge: datetime) -> None:
    """Remove rows older than edge from a folder of date partitions."""
    logs = store.read(spark, path)
    for day in store.days(spark, path):
        if day < edge.date():
            store.drop_day(spark, path, day)
        elif day == edge.date() and edge != datetime(day.year, day.month, day.day, tzinfo=UTC):
            store.replace_day(spark, path, day, kept(logs.where(F.col("dt") == F.lit(day)), edge))


def apply(spark, path: str, as_of: datetime, days: int | None = None) -> int:
    """Remove rows older than the cutoff from the table at path; the number of rows removed."""
    edge = cutoff(as_of, days)
    logs = store.read(spark, path)
    removed = deleted_by_day(logs.where(F.col("dt") <= F.lit(edge.date())), edge).agg(F.coalesce(F.sum("deleted"), F.lit(0))).first()[0]
    drop_before(spark, path, edge)
    return removed
