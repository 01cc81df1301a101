"""Timestamps: ISO 8601 text to and from milliseconds in UTC, and bucket starts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS_MS = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000, "1d": 86_400_000}
_ISO = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
_MIDNIGHT = r"T24:00(:00(\.0+)?)?(?=Z|[+-]|$)"


def parse_iso(text: Column) -> Column:
    """ISO 8601 text as a timestamp cut to milliseconds; null if it isn't. 24:00 is the next midnight."""
    late = text.rlike(_MIDNIGHT)
    plain = F.regexp_replace(text, _MIDNIGHT, "T00:00:00")
    ts = F.when(text.rlike(_ISO), plain.try_cast("timestamp"))
    return F.date_trunc("MILLISECOND", F.when(late, ts + F.expr("INTERVAL 1 DAY")).otherwise(ts))


def iso(ts: Column) -> Column:
    """2024-01-31T13:37:00.000Z"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_start(ts: Column, bucket: str) -> Column:
    """The start of the bucket that ts lies in: whole minutes, hours and days, and five minutes by epoch."""
    if bucket == "5m":
        micros = F.unix_micros(ts)
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(300_000_000)))
    return F.date_trunc({"1m": "MINUTE", "1h": "HOUR", "1d": "DAY"}[bucket], ts)


def instant(value: str | datetime) -> datetime:
    """An ISO 8601 text (without zone: UTC) or a datetime as an aware datetime, cut to milliseconds."""
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    return at.replace(microsecond=at.microsecond // 1000 * 1000)


def millis(at: datetime) -> int:
    gap = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (gap.days * 86_400 + gap.seconds) * 1000 + gap.microseconds // 1000


def literal(at: datetime) -> Column:
    return F.timestamp_millis(F.lit(millis(at)))
