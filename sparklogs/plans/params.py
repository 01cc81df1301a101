"""Parameters of searches and counts, checked before any job starts."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass, field
from datetime import datetime

from ..functions.timestamps import WIDTHS_MS, instant

LEVELS = ("debug", "info", "warn", "error")


def _instant(value: str | datetime, message: str) -> datetime:
    try:
        return instant(value)
    except (ValueError, TypeError) as e:
        raise ValueError(message) from e


def _attributes(given: dict[str, str]) -> dict[str, str]:
    for value in given.values():
        if not isinstance(value, str):
            raise ValueError("attribute values are texts")
    return dict(given)


@dataclass(frozen=True)
class Cursor:
    timestamp: datetime
    id: int

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            raw = json.loads(base64.b64decode(text).decode())
        except (binascii.Error, ValueError) as e:
            raise ValueError("Invalid or malformed cursor") from e
        good = isinstance(raw, dict) and isinstance(raw.get("timestamp"), str) and type(raw.get("id")) is int
        if not good:
            raise ValueError("Malformed cursor structure")
        return cls(_instant(raw["timestamp"], "Malformed cursor structure"), raw["id"])


@dataclass(frozen=True)
class SearchParams:
    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    limit: int = 100
    cursor: Cursor | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, service=None, level=None, since=None, until=None, q=None, limit=None, cursor=None, attributes=None) -> SearchParams:
        if level and level not in LEVELS:
            raise ValueError("Unsupported log level")
        count = 100
        if limit is not None:
            try:
                exact = float(limit)
            except (TypeError, ValueError) as e:
                raise ValueError("Limit must be a valid integer") from e
            if exact != exact or exact in (float("inf"), float("-inf")) or exact != int(exact):
                raise ValueError("Limit must be a valid integer")
            count = int(exact)
            if not 1 <= count <= 1000:
                raise ValueError("Limit must be between 1 and 1000")
        begin = _instant(since, 'Invalid timestamp for "since"') if since else None
        end = _instant(until, 'Invalid timestamp for "until"') if until else None
        if begin and end and end < begin:
            raise ValueError('"until" cannot be earlier than "since"')
        return cls(service, level, begin, end, q, count, Cursor.decode(cursor) if cursor else None, _attributes(attributes or {}))


@dataclass(frozen=True)
class CountParams:
    since: datetime
    until: datetime
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, since=None, until=None, bucket=None, group_by=None, service=None, level=None, q=None, attributes=None) -> CountParams:
        if not since or not until or not bucket:
            raise ValueError("Missing required parameters: since, until, and bucket are required")
        if level and (not isinstance(level, str) or level.lower() not in LEVELS):
            raise ValueError("Unsupported log level")
        begin, end = (_instant(x, "Invalid date format for since or until") for x in (since, until))
        if end < begin:
            raise ValueError("'until' must not be earlier than 'since'")
        if bucket not in WIDTHS_MS:
            raise ValueError("Invalid bucket value. Allowed: 1m, 5m, 1h, 1d")
        if group_by and (not isinstance(group_by, str) or group_by.lower() not in ("service", "level")):
            raise ValueError("Invalid group_by. Allowed: service, level")
        kept = {k: v for k, v in _attributes(attributes or {}).items() if k}
        return cls(begin, end, bucket, group_by.lower() if group_by else None, service, level.lower() if level else None, q, kept)
