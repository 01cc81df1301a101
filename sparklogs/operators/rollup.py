"""Rollups: counts per (bucket, service, level) for minutes, hours and days."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps
from ..plans.params import CountParams

KEYS = ["bucket_start", "service", "level"]


@dataclass
class Rollups:
    minute: DataFrame
    hour: DataFrame
    day: DataFrame


def minutes(logs: DataFrame, since: datetime | None = None) -> DataFrame:
    rows = logs if since is None else logs.where(F.col("timestamp") >= timestamps.literal(since))
    return rows.groupBy(timestamps.bucket_start(F.col("timestamp"), "1m").alias("bucket_start"), "service", "level").agg(F.count("*").alias("count"))


def coarser(finer: DataFrame, bucket: str) -> DataFrame:
    return finer.groupBy(timestamps.bucket_start(F.col("bucket_start"), bucket).alias("bucket_start"), "service", "level").agg(F.sum("count").alias("count"))


def build(logs: DataFrame, since: datetime | None = None) -> Rollups:
    """All three from one scan: hours from minutes, days from hours."""
    minute = minutes(logs, since)
    hour = coarser(minute, "1h")
    return Rollups(minute, hour, coarser(hour, "1d"))


def merged(*parts: DataFrame) -> DataFrame:
    """Deltas of one granularity as one rollup."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def _scan(part: DataFrame, ranges: list[tuple[int, int]], params: CountParams) -> DataFrame:
    """The buckets that start in one of the ranges [since, until): one scan, whose statistics prune it."""
    start, inside = F.col("bucket_start"), F.lit(False)
    for since, until in ranges:
        inside = inside | ((start >= F.timestamp_millis(F.lit(since))) & (start < F.timestamp_millis(F.lit(until))))
    out = part.where(inside)
    if params.service:
        out = out.where(F.col("service") == params.service)
    if params.level:
        out = out.where(F.col("level") == params.level)
    return out


def query(rollups: Rollups, params: CountParams) -> DataFrame:
    """start (timestamp), group, count.

    A bucket belongs to the range if its start does. Hours and days come from the coarse rollup where whole ones fit,
    and from minutes at the two edges, which one scan reads.
    """
    since, until = timestamps.millis(params.since), timestamps.millis(params.until)
    edges, rows = [(since, until)], None
    if params.bucket in ("1h", "1d"):
        width = timestamps.WIDTHS_MS[params.bucket]
        low, high = -(-since // width) * width, until // width * width
        if low < high:
            rows = _scan(rollups.hour if params.bucket == "1h" else rollups.day, [(low, high)], params)
            edges = [(a, b) for a, b in ((since, low), (high, until)) if a < b]
    if edges:
        minutes_ = _scan(rollups.minute, edges, params)
        rows = minutes_ if rows is None else rows.unionByName(minutes_)
    group = F.col(params.group_by) if params.group_by else F.lit(None).cast("string")
    start = timestamps.bucket_start(F.col("bucket_start"), params.bucket)
    return rows.groupBy(start.alias("start"), group.alias("group")).agg(F.sum("count").alias("count"))


def pruned(rollups: Rollups, cutoff: datetime) -> Rollups:
    """Without the buckets that ended at the cutoff or before."""

    def keep(part: DataFrame, bucket: str) -> DataFrame:
        edge = cutoff - timedelta(milliseconds=timestamps.WIDTHS_MS[bucket])
        return part.where(F.col("bucket_start") > timestamps.literal(edge))

    return Rollups(keep(rollups.minute, "1m"), keep(rollups.hour, "1h"), keep(rollups.day, "1d"))


def differing(logs: DataFrame, minute: DataFrame, since: datetime | None = None) -> DataFrame:
    """Keys whose rollup count isn't the count of raw rows: bucket_start, service, level, raw, rolled."""
    raw = minutes(logs, since).withColumnRenamed("count", "raw").withColumnsRenamed({k: f"{k}_" for k in KEYS})
    same = F.lit(True)
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    both = raw.join(minute.withColumnRenamed("count", "rolled"), same, "full_outer")
    keys = [F.coalesce(k, f"{k}_").alias(k) for k in KEYS]
    return both.select(*keys, F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("rolled", F.lit(0)).alias("rolled")).where("raw <> rolled")
