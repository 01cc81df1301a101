"""Reconciling stored rollups with stored rows without counting all rows again.

Beside the rows of each epoch a digest per hour is stored: how many rows, and the sum of a hash of each row's minute,
service and level. Sums don't depend on order, so digests of epochs add up, and the same digest follows from the minute
rollup, where a count stands for as many equal rows. The two are compared as a tree: first a day's sums, then the hours
of the days that differ; only hours that differ are counted again from the rows, which reads their dates alone.

Two different sets of rows have equal sums with a probability of about 2^-64 an hour.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timestamps
from ..schema import LOGS
from ..sources.manifest import Part, Table
from . import rollup, rollup_store

SECTION = "digests"
DIGESTS = T.StructType(
    [T.StructField("hour", T.TimestampType()), T.StructField("rows", T.LongType()), T.StructField("sum", T.DecimalType(38, 0)), T.StructField("dt", T.DateType())]
)


def digest(minutes: DataFrame, count="count") -> DataFrame:
    """hour, rows, sum and dt of minute counts; raw rows are minute counts of 1."""
    hash_ = F.xxhash64("bucket_start", F.coalesce("service", F.lit("")), F.coalesce("level", F.lit(""))).cast("decimal(38,0)")
    n = F.col(count) if isinstance(count, str) else count
    rows = minutes.select(timestamps.bucket_start(F.col("bucket_start"), "1h").alias("hour"), n.cast("long").alias("n"), hash_.alias("h"))
    # a hash has 19 digits and a count of one group fewer than 19, so a product fits
    out = rows.groupBy("hour").agg(F.sum("n").alias("rows"), F.sum((F.col("h") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"))
    return out.withColumn("dt", F.to_date("hour"))


def of_rows(logs: DataFrame) -> DataFrame:
    minute = timestamps.bucket_start(F.col("timestamp"), "1m")
    return digest(logs.select(minute.alias("bucket_start"), "service", "level"), F.lit(1))


def write(table: Table, logs: DataFrame) -> list[Part]:
    """The digests of an epoch's rows: written, not yet committed."""
    return table.write(of_rows(logs).select(*DIGESTS.fieldNames()).coalesce(1), SECTION, by_date=True)


def added(digests: DataFrame, *by: str) -> DataFrame:
    return digests.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("sum").cast("decimal(38,0)").alias("sum"))


def _unequal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose sums aren't those of the other side."""
    other = right.withColumnsRenamed({key: f"{key}_", "rows": "rows_", "sum": "sum_"})
    both = left.join(other, F.col(key) == F.col(f"{key}_"), "full_outer")
    same = F.col("rows").eqNullSafe(F.col("rows_")) & F.col("sum").eqNullSafe(F.col("sum_"))
    return both.where(~same).select(F.coalesce(key, f"{key}_").alias(key))


def differing_hours(spark: SparkSession, path: str, since: datetime | None = None) -> list[int]:
    """Hours (in milliseconds) whose digests of rows and rollup differ, from `since` on (a whole hour): a day first, then its hours."""
    table = Table(spark, path)
    version = table.version()
    rows = table.read(SECTION, DIGESTS, version=version)
    rolled = digest(rollup_store.read(spark, path, version).minute)
    if since is not None:
        rows, rolled = (x.where(F.col("hour") >= timestamps.literal(since)) for x in (rows, rolled))
    days = [r.dt for r in _unequal(added(rows, "dt"), added(rolled, "dt"), "dt").collect()]  # one row per date
    if not days:
        return []
    inside = F.col("dt").isin(days)
    hours = _unequal(added(rows.where(inside), "hour"), added(rolled.where(inside), "hour"), "hour")
    return sorted(r[0] for r in hours.select(F.unix_millis("hour")).collect())  # at most 24 a date


def differing(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """bucket_start, service, level, raw, rolled of the minutes whose rollup count isn't that of the rows."""
    hours = differing_hours(spark, path, since)
    table = Table(spark, path)
    version = table.version()
    days = {str(datetime.fromtimestamp(h / 1000, UTC).date()) for h in hours}
    parts = [p for p in version.of("rows") if p.dt in days]
    starts = [F.timestamp_millis(F.lit(h)) for h in hours]
    hour = timestamps.bucket_start
    logs = table.read_parts(parts, LOGS)
    minute = rollup_store.read(spark, path, version).minute
    if not hours:
        return rollup.differing(logs, minute.limit(0))
    return rollup.differing(logs.where(hour(F.col("timestamp"), "1h").isin(starts)), minute.where(hour(F.col("bucket_start"), "1h").isin(starts)))
