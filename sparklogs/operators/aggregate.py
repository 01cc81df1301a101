"""Counts per time bucket, from raw rows or rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps
from ..plans.params import CountParams
from . import rollup
from .filters import filtered


def counted(rows: DataFrame, ts: str, bucket: str, group_by: str | None, measure) -> DataFrame:
    group = F.col(group_by) if group_by else F.lit(None).cast("string")
    return rows.groupBy(timestamps.bucket_start(F.col(ts), bucket).alias("start"), group.alias("group")).agg(measure.alias("count"))


def ordered(counts: DataFrame) -> DataFrame:
    """By start, then by group in locale order; start as text."""
    rows = counts.orderBy("start", F.expr("`group` COLLATE UNICODE"))
    return rows.select(timestamps.iso(F.col("start")).alias("start"), "group", "count")


def raw(logs: DataFrame, params: CountParams) -> DataFrame:
    """start, group, count from rows: exact to the millisecond at both ends."""
    rows = filtered(logs, params.service, params.level, params.since, params.until, params.q, params.attributes)
    return ordered(counted(rows, "timestamp", params.bucket, params.group_by, F.count("*")))


def route(params: CountParams) -> str:
    """Rollups know neither messages nor attributes."""
    return "raw" if params.q or params.attributes else "rollup"


def counts(logs: DataFrame, rollups: rollup.Rollups, params: CountParams, path: str = "auto") -> DataFrame:
    if (route(params) if path == "auto" else path) == "raw":
        return raw(logs, params)
    return ordered(rollup.query(rollups, params))
