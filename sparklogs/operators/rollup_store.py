"""Stored rollups: minutes, hours and days on disk, as sections of a table with versions (`sources.manifest`).

`add` stores the counts of one epoch (a batch or micro-batch) and commits its minutes, hours and days at once, with the
epoch's number: an epoch that the table has, merged or not, isn't added again, and one that comes late is added like any
other. `compact` merges all folders of a width into one and commits the three widths at once. Readers take the folders
of one version, so neither a crash nor a writer beside them shows them half a change.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps
from ..schema import ROLLUP
from ..sources.manifest import Part, Table, Version
from . import rollup

WIDTHS = {"1m": "minute", "1h": "hour", "1d": "day"}


def deltas(table: Table, minutes: DataFrame) -> list[Part]:
    """Folders of the minute counts, and of the hours and days that they add up to: written, not yet committed."""
    out = table.write(minutes.select(*ROLLUP.fieldNames()), "1m")
    hours = rollup.coarser(table.read_parts(out, ROLLUP), "1h")
    for width, part in (("1h", hours), ("1d", rollup.coarser(hours, "1d"))):
        out += table.write(part.select(*ROLLUP.fieldNames()), width)
    return out


def add(minutes: DataFrame, path: str, epoch: int) -> None:
    """Store the minute counts of one epoch, and the hours and days that they add up to."""
    table = Table(minutes.sparkSession, path)
    if not table.version().has(epoch):
        parts = deltas(table, minutes)
        table.commit(lambda v: None if v.has(epoch) else v.plus(parts, epoch))


def _read(table: Table, parts: list[Part]) -> DataFrame:
    rows = table.read_parts(parts, ROLLUP)
    return rollup.merged(rows) if len(parts) > 1 else rows


def read(spark: SparkSession, path: str, version: Version | None = None) -> rollup.Rollups:
    """The sums of all folders of one version; a folder alone is read as it is."""
    table = Table(spark, path)
    version = version or table.version()
    return rollup.Rollups(*(_read(table, version.of(width)) for width in WIDTHS))


def merged_parts(table: Table, version: Version, cutoff: datetime | None = None) -> tuple[list[Part], list[Part]]:
    """(folders to drop, folders that take their place) of a compaction: written, not yet committed."""
    gone: list[Part] = []
    new: list[Part] = []
    for width in WIDTHS:
        parts = version.of(width)
        if not parts or len(parts) == 1 and cutoff is None:
            continue
        rows = _read(table, parts)
        if cutoff is not None:
            edge = cutoff - timedelta(milliseconds=timestamps.WIDTHS_MS[width])
            rows = rows.where(F.col("bucket_start") > timestamps.literal(edge))
        # sorted by time, so that a range of time reads some row groups only
        gone += parts
        new += table.write(rows.repartitionByRange("bucket_start").sortWithinPartitions("bucket_start"), width)
    return gone, new


def compact(spark: SparkSession, path: str, cutoff: datetime | None = None) -> bool:
    """Merge all folders of each width; with a cutoff, drop the buckets that ended there or before. False if another
    writer replaced a folder meanwhile: then nothing is changed."""
    table = Table(spark, path)
    gone, new = merged_parts(table, table.version(), cutoff)
    if not gone:
        return True
    done = []

    def change(v: Version) -> Version | None:
        done[:] = [set(gone) <= set(v.parts)]
        return v.without(gone).plus(new) if done[0] else None

    table.commit(change)
    return done[0]
