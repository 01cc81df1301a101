"""COPY text: five tab-separated fields with backslash escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps

FIELDS = ("timestamp", "level", "service", "message", "attributes")


def escaped(text: Column) -> Column:
    """Backslash first, then tab, line feed and carriage return."""
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def lines(rows: DataFrame) -> DataFrame:
    """One column `line` per row."""
    kinds = dict(rows.dtypes)
    fields = [timestamps.iso(F.col(c)) if kinds[c] == "timestamp" else F.col(c) for c in FIELDS]
    return rows.select(F.concat_ws("\t", *[escaped(F.coalesce(f, F.lit(""))) for f in fields]).alias("line"))


def write(rows: DataFrame, path: str) -> None:
    lines(rows).write.text(path)
