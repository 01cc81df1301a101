"""Streaming ingest: each micro-batch is validated, stored and counted, and committed at once.

A micro-batch merges the files that came in since the last one. It is validated once, into a folder of checked entries,
from which its rows, rejects and the report of each body are written, and the rollups' deltas from the stored rows.
Nothing of it is seen before all of it is committed as a new version of the table (`sources.manifest`), with the
epoch's number and the ids that it took: an epoch that stopped halfway is done again, one that is in the table isn't.
There is no watermark: rows of any age are kept.

`compact` merges small folders and `expire` drops old rows beside a running stream: both commit to the newest version
and touch only the folders that they planned with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import timestamps
from ..operators import reconcile, retention, rollup, rollup_store, validate
from ..schema import LOGS, REJECTS
from ..sources import store
from ..sources.manifest import Part, Table, Version

BODIES = "batch_id long, body string"
REPORTS = "batch_id long, accepted long, rejected array<struct<index: int, reason: string>>, status int"
#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20


def ingest_epoch(bodies: DataFrame, epoch: int, path: str, clock: Callable[[], datetime], stream: str = "") -> None:
    """Store one micro-batch in the table at path, if it isn't there. Epochs are told apart by their number and stream."""
    spark = bodies.sparkSession
    table = Table(spark, path)
    if table.version().has(epoch, stream):
        return
    top = f"{path}/checked/part={uuid.uuid4().hex}"
    checked = validate.normalised(validate.validated(validate.exploded(bodies), clock()))
    checked.write.mode("overwrite").parquet(top)
    checked = spark.read.schema(checked.schema).parquet(top)
    ranged, offsets, count = validate.ranges(checked.where("reason IS NULL"), f"{path}/checked/part={uuid.uuid4().hex}")
    base = table.version().last_id
    rows = validate.placed(ranged, offsets, base).select(*LOGS.fieldNames())
    parts = table.write(store.spread(rows), "rows", by_date=True)
    parts += table.write(validate.rejected(checked), "rejects") + table.write(validate.report(checked), "reports")
    stored = table.read_parts([p for p in parts if p.section == "rows"], LOGS)
    parts += reconcile.write(table, stored) + rollup_store.deltas(table, rollup.minutes(stored))

    def change(v: Version) -> Version | None:
        if v.has(epoch, stream):
            return None
        if v.last_id != base:
            raise RuntimeError(f"another writer gave out ids beside epoch {epoch} of {path}")
        return v.plus(parts, epoch, base + count, stream)

    table.commit(change)
    for folder in (top, ranged.written_at):
        fs, place = store.filesystem(spark, folder)
        fs.delete(place, True)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return Table(spark, path).read("rows", LOGS)


def rollups(spark: SparkSession, path: str) -> rollup.Rollups:
    """The sums of all deltas, merged or not."""
    return rollup_store.read(spark, path)


def minute_rollup(spark: SparkSession, path: str) -> DataFrame:
    return rollups(spark, path).minute


def reports(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, accepted, rejected and status of every body that had entries."""
    table = Table(spark, path)
    return table.read("reports", spark.createDataFrame([], REPORTS).schema)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    return Table(spark, path).read("rejects", REJECTS)


# --- upkeep beside the stream --------------------------------------------------------------------------------


def small_parts(version: Version, file_bytes: int = FILE_BYTES) -> list[Part]:
    """Dates of rows to merge: those of a date that has several folders, or files of less than half of file_bytes."""
    by_date: dict[str | None, list[Part]] = {}
    for p in version.of("rows"):
        if p.bytes < file_bytes * p.files / 2:  # sized files stay
            by_date.setdefault(p.dt, []).append(p)
    return [p for parts in by_date.values() if sum(x.files for x in parts) > -(-sum(x.bytes for x in parts) // file_bytes) for p in parts]


def _sized(rows: DataFrame, parts: list[Part], file_bytes: int) -> DataFrame:
    """rows dealt to as many tasks per date as files of file_bytes hold its parts, in the order of time inside."""
    total: dict[str | None, int] = {}
    for p in parts:
        total[p.dt] = total.get(p.dt, 0) + p.bytes
    files = {dt: max(1, -(-n // file_bytes)) for dt, n in total.items()}
    per = rows.sparkSession.createDataFrame([(dt, n) for dt, n in files.items()], "dt string, files_ int").withColumn("dt", F.to_date("dt"))
    dealt = rows.join(F.broadcast(per), "dt")  # a row per date
    return dealt.repartition(sum(files.values()), "dt", F.pmod(F.xxhash64("id"), F.col("files_"))).drop("files_").sortWithinPartitions("dt", "timestamp", "id")


def compact(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> int:
    """Merge small files of rows date by date, in one job, and the rollups' deltas; rejects and reports into a folder
    each. The number of folders and dates that went, 0 if another writer replaced one of them meanwhile."""
    table = Table(spark, path)
    version = table.version()
    gone, new = rollup_store.merged_parts(table, version)
    if parts := small_parts(version, file_bytes):
        rows = _sized(table.read_parts(parts, LOGS), parts, file_bytes)
        gone, new = gone + parts, new + table.write(rows.select(*LOGS.fieldNames()), "rows", by_date=True)
    digests = version.of(reconcile.SECTION)
    if len(digests) > len({p.dt for p in digests}):
        rows = reconcile.added(table.read_parts(digests, reconcile.DIGESTS), "hour", "dt").select(*reconcile.DIGESTS.fieldNames())
        gone, new = gone + digests, new + table.write(rows.coalesce(1), reconcile.SECTION, by_date=True)
    for section, schema in (("rejects", REJECTS), ("reports", spark.createDataFrame([], REPORTS).schema)):
        if len(few := [p for p in version.of(section) if p.bytes < file_bytes * p.files / 2]) > 1:
            files = -(-sum(p.bytes for p in few) // file_bytes)
            gone, new = gone + few, new + table.write(table.read_parts(few, schema).repartition(files), section)
    done = _replaced(table, gone, new)
    table.vacuum()
    return done


def _replaced(table: Table, gone: list[Part], new: list[Part]) -> int:
    done = [0]

    def change(v: Version) -> Version | None:
        done[0] = len(gone) if set(gone) <= set(v.parts) else 0
        return v.without(gone).plus(new) if done[0] else None

    if gone:
        table.commit(change)
    return done[0]


def expire(spark: SparkSession, path: str, cutoff: datetime) -> int:
    """Drop stored rows older than the cutoff and the buckets of the rollups that ended before it, at once.

    Earlier dates leave the list, whatever the number of epochs; the cutoff's own date is rewritten by one job. Rows of
    old dates that a stream commits meanwhile go with the next run. The number of folders and dates that went, 0 if
    there was nothing to drop or another writer replaced a folder meanwhile."""
    table = Table(spark, path)
    version, day = table.version(), str(cutoff.date())
    old = [p for p in version.of("rows", reconcile.SECTION) if p.dt is not None and p.dt < day]
    edge = [p for p in version.of("rows") if p.dt == day and cutoff.time() != datetime.min.time()]
    gone, new = rollup_store.merged_parts(table, version, cutoff)
    if edge:
        rows = _sized(retention.kept(table.read_parts(edge, LOGS), cutoff), edge, FILE_BYTES)
        left = table.write(rows.select(*LOGS.fieldNames()), "rows", by_date=True)
        new += left + (reconcile.write(table, table.read_parts(left, LOGS)) if left else [])
        edge += [p for p in version.of(reconcile.SECTION) if p.dt == day]
    done = _replaced(table, gone + old + edge, new)
    table.vacuum()
    return done


# --- the stream ----------------------------------------------------------------------------------------------


@dataclass
class Progress(StreamingQueryListener):
    """What the micro-batches of a query took: input rows, seconds, and how old the oldest file was when it was in."""

    batches: list[dict] = field(default_factory=list)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            began = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp()
            self.batches.append({"epoch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "began": began})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def most_rows(self) -> int:
        return max((b["rows"] for b in self.batches), default=0)


def start(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    clock=lambda: datetime.now(UTC),
    files_per_trigger: int = 100,
    trigger: dict | None = None,
    bytes_per_trigger: int | None = None,
    stream: str = "",
) -> StreamingQuery:
    """Ingest Parquet files of bodies that appear in source; trigger is that of writeStream (default: what is there).

    A micro-batch takes at most files_per_trigger files, or with bytes_per_trigger files of that many bytes: the
    bound of the work in flight. A checkpoint numbers its epochs from 0, and the table takes each number of a stream
    once: a new checkpoint that is to add to the table needs a stream name of its own.
    """
    bound = {"maxBytesPerTrigger": bytes_per_trigger} if bytes_per_trigger else {"maxFilesPerTrigger": files_per_trigger}
    bodies = spark.readStream.schema(BODIES).options(**bound).parquet(source)
    write = bodies.writeStream.foreachBatch(lambda df, epoch: ingest_epoch(df, epoch, path, clock, stream)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


def live_counts(stream: DataFrame, width: str = "1 minute", keep: str | None = None) -> DataFrame:
    """Counts per window, service and level of a stream of logs.

    With keep ("30 days") a window's state ends when the newest time seen lies that far behind its end, as retention
    drops its rows then; rows that are late by less still count. Without, it lives as long as the query.
    """
    if keep:
        stream = stream.withWatermark("timestamp", keep)
    counts = stream.groupBy(F.window("timestamp", width).alias("w"), "service", "level").agg(F.count("*").alias("count"))
    return counts.select(F.col("w")["start"].alias("bucket_start"), "service", "level", "count")


def live_table(stream: DataFrame, path: str, checkpoint: str, width: str = "1 minute", keep: str = "30 days", trigger: dict | None = None) -> StreamingQuery:
    """Keep the live counts of a stream as a stored table: each micro-batch writes the windows that changed.

    State is kept on disk (RocksDB), bounded by `keep`.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def changed(counts: DataFrame, epoch: int) -> None:
        table = Table(spark, path)
        if not table.version().has(epoch):
            parts = table.write(counts.withColumn("epoch", F.lit(epoch).cast("long")), "live")
            table.commit(lambda v: None if v.has(epoch) else v.plus(parts, epoch))

    write = live_counts(stream, width, keep).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


LIVE = "bucket_start timestamp, service string, level string, count long, epoch long"


def live_rows(spark: SparkSession, path: str) -> DataFrame:
    """The counts as they are after the last micro-batch: of each window's updates the newest."""
    rows = Table(spark, path).read("live", spark.createDataFrame([], LIVE).schema)
    return rows.groupBy("bucket_start", "service", "level").agg(F.max_by("count", "epoch").alias("count"))


def live_compact(spark: SparkSession, path: str, cutoff: datetime | None = None) -> int:
    """Keep only each window's newest count, without windows that began before the cutoff."""
    table = Table(spark, path)
    parts = table.version().of("live")
    rows = table.read_parts(parts, spark.createDataFrame([], LIVE).schema)
    rows = rows.groupBy("bucket_start", "service", "level").agg(F.max_by("count", "epoch").alias("count"), F.max("epoch").alias("epoch"))
    if cutoff is not None:
        rows = rows.where(F.col("bucket_start") >= timestamps.literal(cutoff))
    return _replaced(table, parts, table.write(rows, "live")) if parts else 0
