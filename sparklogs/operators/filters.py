"""Conjunctive filters over logs; an empty value is no filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, timestamps
from ..functions.attributes import promoted


def filtered(
    logs: DataFrame,
    service: str | None = None,
    level: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    q: str | None = None,
    attributes: dict[str, str] | None = None,
    q_literal: str | None = None,
) -> DataFrame:
    """Rows that pass every given filter; [since, until) also prunes the date partitions."""
    out = logs
    if since:
        at = timestamps.literal(since)
        out = out.where(F.col("timestamp") >= at)
        if "dt" in logs.columns:
            out = out.where(F.col("dt") >= F.lit(since.date()))
    if until:
        out = out.where(F.col("timestamp") < timestamps.literal(until))
        if "dt" in logs.columns:
            out = out.where(F.col("dt") <= F.lit(until.date()))
    if service:
        out = out.where(F.col("service") == service)
    if level:
        out = out.where(F.col("level") == level)
    for key, value in (attributes or {}).items():
        name = promoted(key)
        # a column of its own reaches the scan's filters, a map's entry doesn't
        out = out.where((F.col(name) if name in logs.columns else F.col("attributes_search")[key]) == value)
    if q:
        out = out.where(patterns.matches(F.col("message"), q))
    if q_literal:
        out = out.where(F.contains(F.lower("message"), F.lower(F.lit(q_literal))))
    return out
