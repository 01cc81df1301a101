"""Search: newest first, keyset pages, opaque cursors."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps
from ..plans.params import Cursor, SearchParams
from .filters import filtered


def ordered(logs: DataFrame, params: SearchParams) -> DataFrame:
    """All rows that the parameters ask for, newest first; to be cut by a limit."""
    out = filtered(logs, params.service, params.level, params.since, params.until, params.q, params.attributes)
    if params.cursor:
        at = timestamps.literal(params.cursor.timestamp)
        # the first condition is implied by the second; it reaches the scan and prunes dates
        out = out.where(F.col("timestamp") <= at).where((F.col("timestamp") < at) | (F.col("id") < params.cursor.id))
        if "dt" in logs.columns:
            out = out.where(F.col("dt") <= F.lit(params.cursor.timestamp.date()))
    return out.orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("id"))


def columns() -> list:
    """The columns that users see: id as text, ISO timestamp, level, service, message, attributes."""
    return [F.col("id").cast("string").alias("id"), timestamps.iso(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes"]


def shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*columns())


def page(logs: DataFrame, params: SearchParams) -> DataFrame:
    """At most params.limit rows, newest first: a top-k, never a full sort."""
    return shaped(ordered(logs, params).limit(params.limit))


def encode_cursor(timestamp: str, id_: int) -> str:
    return base64.b64encode(json.dumps({"timestamp": timestamp, "id": id_}, separators=(",", ":")).encode()).decode()


def page_report(logs: DataFrame, params: SearchParams) -> DataFrame:
    """One row: rows of the page, and next_cursor (null on the last page).

    The limit + 1 newest rows meet in one task; there are at most 1001.
    """
    rows = ordered(logs.select(*[c for c in logs.columns if c != "attributes"]), params).limit(params.limit + 1)
    rows = rows.select(F.struct(F.col("timestamp").alias("ts"), "id").alias("at"))
    newest = rows.agg(F.sort_array(F.collect_list("at"), asc=False).alias("all"))
    last = F.col("all")[params.limit - 1]
    text = F.to_json(F.struct(timestamps.iso(last["ts"]).alias("timestamp"), last["id"].alias("id")))
    more = F.size("all") > params.limit
    return newest.select(
        F.least(F.size("all"), F.lit(params.limit)).cast("long").alias("rows"), F.when(more, F.base64(text.cast("binary"))).alias("next_cursor")
    )


@dataclass
class Page:
    rows: list
    next_cursor: str | None


def fetch(logs: DataFrame, params: SearchParams) -> Page:
    """One page on the driver (at most 1000 rows) and the cursor of the next."""
    rows = shaped(ordered(logs, params).limit(params.limit + 1)).collect()
    rows, more = rows[: params.limit], len(rows) > params.limit
    return Page(rows, encode_cursor(rows[-1]["timestamp"], int(rows[-1]["id"])) if more else None)


def walk(logs: DataFrame, params: SearchParams, pages: int) -> DataFrame:
    """The rows of the first `pages` pages, each its own top-k after the cursor of the one before, and read once."""
    rows: list = []
    for _ in range(pages):
        page = fetch(logs, params)
        rows += page.rows
        if page.next_cursor is None:
            break
        params = replace(params, cursor=Cursor.decode(page.next_cursor))
    return logs.sparkSession.createDataFrame(rows, shaped(logs.limit(0)).schema)
