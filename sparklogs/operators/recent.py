"""Newest-first search over a table of date partitions, newest dates first.

A page that names no `since` would read every date for a top-k of a few rows. Here dates are taken from the newest on
until limit + 1 rows are certain: rows of an earlier date come behind all of a later one. How many dates a step takes is
told by their numbers of rows, where the table's version has them and no filter but time applies; else each step takes
twice as many as the one before. Each step is a top-k of its own over its own dates, for the rows that are still missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..plans.params import Cursor, SearchParams
from ..schema import LOGS
from ..sources import store
from ..sources.manifest import NO_DATE, Table
from .search import Page, encode_cursor, ordered, shaped


@dataclass(frozen=True)
class Dates:
    """The dates of a table, newest first, with their rows (None: not known), and how to read some of them."""

    rows: dict[date, int | None]
    read: Callable[[list[date]], DataFrame]


def of_table(spark: SparkSession, path: str, section: str = "rows") -> Dates:
    """The dates of a section of a table with versions: all steps read one version."""
    table = Table(spark, path)
    parts = [p for p in table.version().of(section) if p.dt not in (None, NO_DATE)]
    rows: dict[date, int | None] = {}
    for p in sorted(parts, key=lambda p: p.dt, reverse=True):
        day = date.fromisoformat(p.dt)
        rows[day] = (rows.get(day) or 0) + p.rows
    return Dates(rows, lambda days: table.read_parts([p for p in parts if date.fromisoformat(p.dt) in set(days)], LOGS))


def of_folder(spark: SparkSession, path: str) -> Dates:
    """The dates of a plain folder of date partitions."""
    rows: dict[date, int | None] = dict.fromkeys(sorted(store.days(spark, path), reverse=True))
    top = path.rstrip("/")
    return Dates(rows, lambda days: spark.read.schema(LOGS).option("basePath", top).parquet(*[f"{top}/dt={d}" for d in days]))


def steps(dates: Dates, params: SearchParams, need: int):
    """Lists of dates to read one after the other. Each is sent the number of rows still missing after it."""
    since, until = params.since and params.since.date(), params.until and params.until.date()
    if params.cursor:
        until = min(until or date.max, params.cursor.timestamp.date())
    days = [d for d in dates.rows if (since is None or d >= since) and (until is None or d <= until)]
    filtered = bool(params.service or params.level or params.q or params.attributes)
    # rows of the first and last date may lie outside of the range
    certain = {d: n for d, n in dates.rows.items() if n is not None and not filtered and d not in (since, until)}
    at, width = 0, 1
    while at < len(days) and need > 0:
        end, known = at, 0
        while end < len(days) and known < need and (end - at < width or days[end] in certain):
            known += certain.get(days[end], 0)
            end += 1
        need = yield days[at:end]
        at, width = end, 2 * width


def fetch(dates: Dates, params: SearchParams) -> tuple[Page, list[date]]:
    """A page (at most 1000 rows), as `search.fetch` gives it, and the dates that were read."""
    found: list = []
    seen: list[date] = []
    plan = steps(dates, params, params.limit + 1)
    days = next(plan, None)
    while days is not None:
        seen += days
        rows = dates.read(days)
        found += shaped(ordered(rows, params).limit(params.limit + 1 - len(found))).collect()
        try:
            days = plan.send(params.limit + 1 - len(found))
        except StopIteration:
            break
    rows, more = found[: params.limit], len(found) > params.limit
    return Page(rows, encode_cursor(rows[-1]["timestamp"], int(rows[-1]["id"])) if more else None), seen


def walk(dates: Dates, params: SearchParams, pages: int) -> tuple[list, list[list[date]]]:
    """The rows of the first `pages` pages, each read once, and the dates that each page read."""
    rows: list = []
    seen: list[list[date]] = []
    for _ in range(pages):
        page, days = fetch(dates, params)
        rows += page.rows
        seen.append(days)
        if page.next_cursor is None:
            break
        params = replace(params, cursor=Cursor.decode(page.next_cursor))
    return rows, seen
