"""The registered queries. Each takes (spark, sf_dir) and reads the whole tables there."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps
from ..functions.timestamps import instant
from ..operators import aggregate, filters, recent, reconcile, retention, rollup, rollup_store, search, validate
from ..schema import LOGS
from ..session import prepared
from ..sources import bodies, copytext, events, generate, store, workdir
from ..sources.manifest import Table
from ..streaming import ingest
from .params import CountParams, Cursor, SearchParams

Query = Callable[[SparkSession, str], DataFrame]

AS_OF, AS_OF_INSIDE = instant("2024-01-31T00:00:00Z"), instant("2024-01-31T13:37:00Z")
ALIGNED = (instant("2024-01-05T00:00:00Z"), instant("2024-01-12T00:00:00Z"))
UNALIGNED = (instant("2024-01-05T09:45:30.500Z"), instant("2024-01-12T12:20:15.250Z"))
RETENTION_DAYS = 15
CURSOR = Cursor(instant("2024-01-20T12:00:00Z"), 6000)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.logs(_table(spark, sf_dir, "events"))


#: What was stored for a query's table in this application: bodies that came in, rollups of the logs.
_kept: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = (prepared(spark).sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        path = workdir.fresh(spark, name)
        write(path)
        _kept[key] = path
    return _kept[key]


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request bodies, as they are stored when they come in."""
    path = _once(spark, sf_dir, "bodies", lambda p: events.bodies(_table(spark, sf_dir, "events"), AS_OF).write.parquet(p))
    return spark.read.schema(ingest.BODIES).parquet(path)


def _rollups(spark: SparkSession, sf_dir: str) -> rollup.Rollups:
    """The stored rollups of the logs: all of them were merged into the base, as after a night's compaction."""

    def write(path: str) -> None:
        rollup_store.add(rollup.minutes(_logs(spark, sf_dir)), path, 0)
        rollup_store.compact(spark, path)

    return rollup_store.read(spark, _once(spark, sf_dir, "rollups", write))


def _grown(spark: SparkSession, sf_dir: str, merge_after: tuple[int, ...]) -> rollup.Rollups:
    """Rollups that four increments of the logs were added to, merged after some of them."""
    path, logs = workdir.fresh(prepared(spark), "rollups"), _logs(spark, sf_dir)
    for k in range(4):
        rollup_store.add(rollup.minutes(logs.where(F.pmod("id", F.lit(4)) == k)), path, k)
        if k in merge_after:
            rollup_store.compact(spark, path)
    return rollup_store.read(spark, path)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with times cut to the hour, so that many rows tie and the id decides."""
    return _logs(spark, sf_dir).withColumn("timestamp", F.date_trunc("HOUR", "timestamp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and service over a week."""
    return aggregate.raw(_logs(spark, sf_dir), CountParams(*ALIGNED, "1h", "service"))


def _filter(**conditions) -> Query:
    return lambda spark, sf_dir: search.shaped(filters.filtered(_logs(spark, sf_dir), **conditions))


def _page(params: SearchParams, view=_logs) -> Query:
    return lambda spark, sf_dir: search.page(view(spark, sf_dir), params)


def _raw(since, until, bucket, group_by=None, **conditions) -> Query:
    params = CountParams(since, until, bucket, group_by, **conditions)
    return lambda spark, sf_dir: aggregate.raw(_logs(spark, sf_dir), params)


def _rolled(since, until, bucket, group_by=None, **conditions) -> Query:
    params = CountParams(since, until, bucket, group_by, **conditions)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate.counts(_logs(spark, sf_dir), _rollups(spark, sf_dir), params)

    return run


def _shown(part: DataFrame) -> DataFrame:
    return part.select(timestamps.iso(F.col("bucket_start")).alias("start"), "service", "level", "count")


def logs_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return logs.select(*search.columns(), F.col("attributes_search")["k"].alias("k"))


def rollup_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a base and two deltas that aren't merged yet."""
    return aggregate.ordered(rollup.query(_grown(spark, sf_dir, (1,)), CountParams(*UNALIGNED, "1h", "level")))


def rollup_late_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups that took in epochs 0 and 2, were merged, and took in 1, 3 and 2 again: every epoch counts once."""
    path, logs = workdir.fresh(prepared(spark), "rollups"), _logs(spark, sf_dir)
    for k in (0, 2, None, 1, 3, 2):
        if k is None:
            rollup_store.compact(spark, path)
        else:
            rollup_store.add(rollup.minutes(logs.where(F.pmod("id", F.lit(4)) == k)), path, k)
    return _by_width(rollup_store.read(spark, path))


def rollup_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_width(_grown(spark, sf_dir, (0, 2, 3)))


def agg_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and service with the place that each row has in the result (at most a row per hour and service)."""
    rows = flagship(spark, sf_dir).collect()
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], 'place long, start string, `group` string, count long')


def agg_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that rollups can answer, and counts that raw rows must."""
    one, two = CountParams(*UNALIGNED, "1d", "service"), CountParams(*UNALIGNED, "1d", "service", q="user 1")
    rows = [aggregate.counts(_logs(spark, sf_dir), _rollups(spark, sf_dir), p).withColumn("path", F.lit(aggregate.route(p))) for p in (one, two)]
    return rows[0].unionByName(rows[1])


def search_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the cursor text that the first page's report gives."""
    params = SearchParams(limit=50)
    text = search.page_report(_logs(spark, sf_dir), params).first()["next_cursor"]
    return search.page(_logs(spark, sf_dir), replace(params, cursor=Cursor.decode(text)))


def search_page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_report(_logs(spark, sf_dir), SearchParams(limit=50))


def search_page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.walk(_hourly(spark, sf_dir), SearchParams(level="error", limit=40), pages=4)


def _dated(spark: SparkSession, sf_dir: str) -> str:
    """The logs as a table with versions, by date."""

    def write(path: str) -> None:
        table = Table(spark, path)
        parts = table.write(store.spread(_logs(spark, sf_dir).select(*LOGS.fieldNames())).sortWithinPartitions("dt", "timestamp"), "rows", by_date=True)
        table.commit(lambda v: v.plus(parts, 0))

    return _once(spark, sf_dir, "dated", write)


def _descending(spark: SparkSession, sf_dir: str, pages: list[tuple[SearchParams, int]]) -> DataFrame:
    dates = recent.of_table(spark, _dated(spark, sf_dir))
    rows = [(*r, str(k)) for k, (params, n) in enumerate(pages) for r in recent.walk(dates, params, n)[0]]
    return spark.createDataFrame(rows, "id string, timestamp string, level string, service string, message string, attributes string, search string")


def search_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest pages of a table that is read from its newest date on: plain, filtered, and walked from a cursor."""
    plain, rare = SearchParams(limit=1000), SearchParams(service="payment", level="error", attributes={"k": "9"}, limit=30)
    return _descending(spark, sf_dir, [(plain, 2), (rare, 1), (SearchParams(limit=100, since=UNALIGNED[0], until=UNALIGNED[1], cursor=Cursor(instant("2024-01-11T12:00:00Z"), 1)), 3)])


def rollup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return _shown(rollup.merged(*[rollup.minutes(logs.where(F.pmod("id", F.lit(3)) == k)) for k in range(3)]))


def rollup_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    minute = rollup.minutes(logs)
    wrong = rollup.differing(logs, minute).agg(F.count("*").alias("differing"))
    return wrong.crossJoin(minute.agg(F.sum("count").alias("rolled"))).crossJoin(logs.agg(F.count("*").alias("raw")))


def rollup_reconcile_differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes whose stored rollup isn't what the stored rows give: one row in 501 was never counted, some counted twice."""
    path, logs = workdir.fresh(prepared(spark), "reconciled"), _logs(spark, sf_dir)
    table = Table(spark, path)
    for k in range(2):
        some = logs.where(F.pmod("id", F.lit(2)) == k)
        parts = table.write(store.spread(some.select(*LOGS.fieldNames())), "rows", by_date=True)
        wrong = some.where("id % 501 <> 7").union(some.where("id % 1009 = 3"))
        parts += reconcile.write(table, some) + rollup_store.deltas(table, rollup.minutes(wrong))
        table.commit(lambda v, parts=parts, k=k: v.plus(parts, k))
    out = reconcile.differing(spark, path)
    return out.select(timestamps.iso(F.col("bucket_start")).alias("start"), "service", "level", "raw", "rolled")


def filter_attr_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by an attribute that the stored table holds as a column, and by one that it doesn't."""
    path = _once(spark, sf_dir, "promoted", lambda p: store.write(_logs(spark, sf_dir), p, promote=["k"]))
    logs = store.read(spark, path, ["k"])
    one, two = filters.filtered(logs, attributes={"k": "7"}), filters.filtered(logs, level="error", attributes={"k": "3", "none": "x"})
    return search.shaped(one.unionByName(two))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validated(validate.exploded(_bodies(spark, sf_dir)), AS_OF)


def ingest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("batch_id", F.col("index").cast("long").alias("index"), "reason")


def _reported(report: DataFrame) -> DataFrame:
    lines = F.transform("rejected", lambda r: F.concat_ws(":", r["index"].cast("string"), r["reason"]))
    return report.select("batch_id", "accepted", F.array_join(lines, ";").alias("rejected"), "status")


def ingest_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(validate.report(_checked(spark, sf_dir)))


def ingest_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.envelopes(_bodies(spark, sf_dir)).select("batch_id", "outcome")


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select(
        timestamps.iso(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes", F.col("attributes_search")["k"].alias("k")
    )


def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.with_ids(validate.accepted(_checked(spark, sf_dir)))
    return rows.select(
        "id", timestamps.iso(F.col("timestamp")).alias("timestamp"), "level", "service", "message", "attributes", F.col("attributes_search")["k"].alias("k")
    )


def ingest_ids_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of accepted entries whose batch ids have wide gaps, and of those that have none."""
    b = F.col("batch_id")
    sparse = _bodies(spark, sf_dir).withColumn("batch_id", F.when(b % 7 == 3, F.lit(None)).when(b % 11 == 5, b * 1_000_000_000_000).otherwise(b).cast("long"))
    return validate.with_ids(validate.accepted(validate.validated(validate.exploded(sparse), AS_OF))).select("id", "batch_id", F.col("index").cast("long").alias("index"))


def ingest_envelope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of bodies that lie in text files: one in each line, and one in each file, of which one is too large."""
    path, rows = workdir.fresh(prepared(spark), "text"), _bodies(spark, sf_dir)
    rows.select("body").write.text(f"{path}/lines")
    some = rows.where("batch_id % 10 = 1 OR batch_id % 23 = 0")
    large = rows.where("batch_id = 1").select(F.lit(-1).cast("long").alias("batch_id"), F.concat("body", F.repeat(F.lit(" "), validate.BODY_LIMIT)).alias("body"))
    some.unionByName(large).repartition("batch_id").write.partitionBy("batch_id").option("maxRecordsPerFile", 1).text(f"{path}/files")
    count = lambda e: e.groupBy("batch", "outcome").agg(F.count("*").alias("bodies"))
    by_line = validate.envelopes(bodies.lines(spark, f"{path}/lines")).withColumn("batch", F.lit(None).cast("long"))
    by_file = validate.envelopes(bodies.whole(spark, f"{path}/files")).withColumn("batch", F.regexp_extract("batch_id", "batch_id=(-?[0-9]+)", 1).cast("long"))
    return count(by_line).unionByName(count(by_file))


def unnest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("id") / events.PER_BATCH).cast("long"))
    rows = rows.withColumn("ts", timestamps.iso(F.col("timestamp")))
    one = F.sort_array(F.collect_list(F.struct("id", "ts", "level", "service", "message", "attributes")))
    arrays = rows.groupBy("batch_id").agg(one.alias("r")).select(  # 50 rows each
        "batch_id", F.col("r.ts").alias("ts"), F.col("r.level").alias("lvl"), F.col("r.service").alias("svc"), F.col("r.message").alias("msg"), F.col("r.attributes").alias("attr")
    )
    out = store.rows_of(arrays)
    return out.withColumn("timestamp", timestamps.iso(F.col("timestamp")))


def copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(
        timestamps.literal(AS_OF).alias("timestamp"), F.col("lang").alias("level"), F.col("source").alias("service"), F.col("text").alias("message"), F.lit("{}").alias("attributes")
    )
    return copytext.lines(rows)


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shaped(retention.kept(_logs(spark, sf_dir), retention.cutoff(AS_OF, RETENTION_DAYS)))


def retention_deleted_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retention.deleted_by_day(_logs(spark, sf_dir), retention.cutoff(AS_OF_INSIDE, RETENTION_DAYS))
    return out.select(F.col("dt").cast("string").alias("dt"), "deleted")


def _by_width(rolled: rollup.Rollups) -> DataFrame:
    parts = [_shown(part).withColumn("width", F.lit(w)) for w, part in (("1m", rolled.minute), ("1h", rolled.hour), ("1d", rolled.day))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rollup_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollups after they were pruned on disk."""
    path = workdir.fresh(prepared(spark), "rollups")
    rollup_store.add(rollup.minutes(_logs(spark, sf_dir)), path, 0)
    rollup_store.compact(spark, path, retention.cutoff(AS_OF_INSIDE, RETENTION_DAYS))
    return _by_width(rollup_store.read(spark, path))


def retention_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after the retention job: what is read back."""
    path = workdir.fresh(prepared(spark), "logs")
    store.write(_logs(spark, sf_dir), path)
    retention.apply(spark, path, AS_OF_INSIDE, RETENTION_DAYS)
    return search.shaped(store.read(spark, path))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Ingest the bodies as a stream, three files to a micro-batch; where the result lies."""
    path = workdir.fresh(prepared(spark), "stream")
    _bodies(spark, sf_dir).repartition(8, "batch_id").write.parquet(f"{path}/in")
    query = ingest.start(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", clock=lambda: AS_OF, files_per_trigger=3)
    query.awaitTermination()
    return f"{path}/out"


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(ingest.reports(spark, _streamed(spark, sf_dir)))


def stream_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream stored, after rows and rollups were expired on disk: the day counts of the rows left, and the rollup's days."""
    path, edge = _streamed(spark, sf_dir), retention.cutoff(AS_OF_INSIDE, RETENTION_DAYS)
    ingest.expire(spark, path, edge)
    kept = rollup.coarser(rollup.minutes(ingest.stored_rows(spark, path)), "1d")
    return _shown(kept).withColumn("of", F.lit("rows")).unionByName(_shown(ingest.rollups(spark, path).day).withColumn("of", F.lit("rollup")))


def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream stored, after its small files were merged and what they replaced was removed."""
    path = _streamed(spark, sf_dir)
    ingest.compact(spark, path)
    Table(spark, path).vacuum(1, 0)
    return _stored(ingest.stored_rows(spark, path))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day counts after bodies came in by descending number, so that each micro-batch is later than all before it."""
    path = workdir.fresh(prepared(spark), "late")
    bodies = _bodies(spark, sf_dir)
    for k, some in enumerate((bodies.where("batch_id % 3 = 2"), bodies.where("batch_id % 3 = 1"), bodies.where("batch_id % 3 = 0"))):
        ingest.ingest_epoch(some, 2 - k, path, lambda: AS_OF)
        if k == 1:
            ingest.compact(spark, path)
    return _shown(ingest.rollups(spark, path).day)


def stream_live_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts per day, of which state and table keep the last ten days."""
    path = workdir.fresh(prepared(spark), "live")
    logs = _logs(spark, sf_dir).select("timestamp", "service", "level")
    logs.repartitionByRange(6, "timestamp").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.live_table(stream, f"{path}/out", f"{path}/checkpoint", "1 day", "10 days").awaitTermination()
    ingest.live_compact(spark, f"{path}/out", AS_OF - timedelta(days=10))
    return _shown(ingest.live_rows(spark, f"{path}/out"))


def stream_live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts per hour of the logs as a stream, after all of it was read."""
    path = workdir.fresh(prepared(spark), "live")
    logs = _logs(spark, sf_dir).select("timestamp", "service", "level")
    logs.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def store_counts(counts: DataFrame, epoch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/out")

    write = ingest.live_counts(stream, "1 hour").writeStream.outputMode("complete").foreachBatch(store_counts)
    write.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{path}/out"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(ingest.stored_rows(spark, _streamed(spark, sf_dir)))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ingest.minute_rollup(spark, _streamed(spark, sf_dir)))


def _outcome(check: Callable[[], object]) -> str:
    try:
        check()
    except ValueError as e:
        return str(e)
    return "accepted"


def parameters_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of search and count parameters say to requests made of event types, and of how many events.

    A row for each event type and kind of request: 35 at most.
    """
    kinds = _table(spark, sf_dir, "events").groupBy("event_type", F.pmod("user_id", F.lit(7)).alias("kind")).agg(F.count("*").alias("events")).collect()
    not_json = base64.b64encode(b"not JSON").decode()

    def of_search(kind: int, word: str) -> SearchParams:
        given = [{"limit": "0"}, {"level": word, "limit": "1000"}, {"limit": f"{word}1"}, {"level": word.upper()}, {"since": word}, {"since": "2024-01-02", "until": "2024-01-01"}, {"cursor": not_json}]
        return SearchParams.of(**given[kind])

    def of_counts(kind: int, word: str) -> CountParams:
        good = {"since": "2024-01-01", "until": "2024-01-02T00:00:00Z", "bucket": "1h"}
        given = [{"bucket": ""}, {"level": word.upper()}, {"bucket": "2m"}, {"group_by": word}, {"until": word}, {"until": "2023-12-31"}, {"group_by": "SERVICE"}]
        return CountParams.of(**good | given[kind])

    rows = [(r.event_type, r.kind, r.events, _outcome(lambda r=r: of_search(r.kind, r.event_type)), _outcome(lambda r=r: of_counts(r.kind, r.event_type))) for r in kinds]
    return spark.createDataFrame(rows, "event_type string, kind long, events long, search string, counts string")


def generate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated row for every event."""
    out = generate.generated(_table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), AS_OF - timedelta(days=30))
    return out.withColumn("timestamp", timestamps.iso(F.col("timestamp")))


def queries() -> dict[str, Query]:
    rolled = lambda w: lambda spark, sf_dir: _shown(getattr(rollup.build(_logs(spark, sf_dir)), w))
    return {
        "logs_projection": logs_projection,
        "filter_service": _filter(service="auth"),
        "filter_level": _filter(level="error"),
        "filter_time_range": _filter(since=UNALIGNED[0], until=UNALIGNED[1]),
        "filter_q": _filter(q="PURCHASE by"),
        "filter_q_wildcard": _filter(q=r"p_rchase%user\ 1_"),
        "filter_q_literal": _filter(q_literal="Error by user 1"),
        "filter_attr": _filter(attributes={"k": "7"}),
        "filter_attr_promoted": filter_attr_promoted,
        "filter_combined": _filter(service="payment", level="info", since=ALIGNED[0], until=ALIGNED[1], q="click", attributes={"k": "3"}),
        "search_first_page": _page(SearchParams(limit=50)),
        "search_next_page": _page(SearchParams(limit=50, cursor=CURSOR), _hourly),
        "search_filtered_page": _page(SearchParams(service="inventory", level="warn", limit=25)),
        "search_descending": search_descending,
        "search_page_report": search_page_report,
        "search_page_walk": search_page_walk,
        "agg_1m": _raw(*UNALIGNED, "1m"),
        "agg_5m": _raw(*UNALIGNED, "5m"),
        "agg_1h": _raw(*UNALIGNED, "1h"),
        "agg_1d": _raw(*UNALIGNED, "1d"),
        "agg_1h_by_service": flagship,
        "agg_1d_by_level": _raw(*UNALIGNED, "1d", "level"),
        "agg_1h_q": _raw(*UNALIGNED, "1h", q="by user 1"),
        "agg_1h_attr": _raw(*UNALIGNED, "1h", attributes={"k": "5"}),
        "agg_5m_filtered": _raw(*ALIGNED, "5m", "level", service="checkout", level="error"),
        "rollup_minute": rolled("minute"),
        "rollup_hour": rolled("hour"),
        "rollup_day": rolled("day"),
        "rollup_query_1m": _rolled(*UNALIGNED, "1m"),
        "rollup_query_5m": _rolled(*UNALIGNED, "5m", "service"),
        "rollup_query_1h_unaligned": _rolled(*UNALIGNED, "1h", "level"),
        "rollup_query_1d_by_service": _rolled(*UNALIGNED, "1d", "service"),
        "rollup_query_narrow": _rolled(instant("2024-01-05T09:45:30.500Z"), instant("2024-01-05T10:10:00Z"), "1h"),
        "rollup_incremental": rollup_incremental,
        "rollup_reconcile": rollup_reconcile,
        "rollup_reconcile_differing": rollup_reconcile_differing,
        "ingest_validate": ingest_validate,
        "ingest_batch_report": ingest_batch_report,
        "ingest_envelope": ingest_envelope,
        "ingest_accepted": ingest_accepted,
        "ingest_ids_sparse": ingest_ids_sparse,
        "ingest_envelope_text": ingest_envelope_text,
        "unnest_batches": unnest_batches,
        "copy_text": copy_text,
        "retention_keep": retention_keep,
        "retention_deleted_by_day": retention_deleted_by_day,
        "retention_apply": retention_apply,
        "rollup_pruned": rollup_pruned,
        "stream_ingest": stream_ingest,
        "stream_rollup": stream_rollup,
        "generate_logs": generate_logs,
        "parameters_checked": parameters_checked,
        "rollup_store_query": rollup_store_query,
        "rollup_compacted": rollup_compacted,
        "rollup_late_epoch": rollup_late_epoch,
        "agg_routed": agg_routed,
        "agg_in_order": agg_in_order,
        "search_cursor_page": search_cursor_page,
        "stream_report": stream_report,
        "stream_expired": stream_expired,
        "stream_live_counts": stream_live_counts,
        "stream_live_bounded": stream_live_bounded,
        "stream_compacted": stream_compacted,
        "stream_late": stream_late,
    }
