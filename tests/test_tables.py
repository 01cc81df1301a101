from datetime import UTC, datetime

from sparklogs.functions.timestamps import instant
from sparklogs.operators import retention, rollup
from sparklogs.plans import queries
from sparklogs.sources import copytext, events, generate, store
from sparklogs.sources.manifest import Table
from sparklogs.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_copy_text(spark):
    rows = spark.createDataFrame(
        [("2026-01-01T00:00:00.000Z", "info", "s", "a\\b\tc\nd\re", '{"i": 1}'), ("t", "error", "x", "plain", "{}")],
        "timestamp string, level string, service string, message string, attributes string",
    )
    assert [r.line for r in copytext.lines(rows).collect()] == ['2026-01-01T00:00:00.000Z\tinfo\ts\ta\\\\b\\tc\\nd\\re\t{"i": 1}', "t\terror\tx\tplain\t{}"]
    assert copytext.lines(rows.limit(0)).count() == 0


def test_retention_on_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = events.logs(spark.read.parquet(f"{SF}/events.parquet"))
    store.write(logs, path)
    assert store.read(spark, path).count() == 1000
    old = logs.where("timestamp < '2024-01-16 13:37:00'").count()
    assert retention.apply(spark, path, queries.AS_OF_INSIDE, 15) == old > 0
    left = store.read(spark, path)
    assert left.count() == 1000 - old and left.where("timestamp < '2024-01-16 13:37:00'").count() == 0
    assert store.days(spark, path)[0].isoformat() == "2024-01-16"
    assert retention.apply(spark, path, queries.AS_OF_INSIDE, 15) == 0
    assert retention.cutoff(queries.AS_OF, 0) == retention.cutoff(queries.AS_OF) == instant("2024-01-01")


def test_stream_can_be_replayed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    bodies = events.bodies(spark.read.parquet(f"{SF}/events.parquet"), queries.AS_OF)
    for k in range(3):
        bodies.where(f"batch_id % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    clock = lambda: queries.AS_OF
    ingest.start(spark, source, out, str(tmp_path / "c1"), clock, 1).awaitTermination()
    rows = ingest.stored_rows(spark, out)
    before = sorted((r.id, r.message) for r in rows.collect())
    rejects = ingest.rejects(spark, out).count()
    ids = [r[0] for r in before]
    assert len(set(ids)) == len(ids) > 500 and Table(spark, out).version().epochs == (("", 0, 2),)
    assert rollup.differing(rows, ingest.minute_rollup(spark, out)).count() == 0
    # the same epochs again: they are in the table
    later = lambda: datetime(2030, 1, 1, tzinfo=UTC)
    ingest.start(spark, source, out, str(tmp_path / "c2"), later, 1).awaitTermination()
    after = sorted((r.id, r.message) for r in ingest.stored_rows(spark, out).collect())
    assert after == before and ingest.rejects(spark, out).count() == rejects
    assert not list((tmp_path / "out/checked").iterdir())


def test_new_rows_can_be_found_after_the_trigger(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    body = '{"logs":[{"timestamp":"2024-01-30T00:00:00Z","level":"info","service":"s","message":"m","attributes":{"probe_id":"p1"}}]}'
    spark.createDataFrame([(1, body)], ingest.BODIES).write.parquet(source)
    query = ingest.start(spark, source, out, str(tmp_path / "c"), lambda: queries.AS_OF, trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    query.stop()
    assert ingest.stored_rows(spark, out).where("attributes_search['probe_id'] = 'p1'").count() == 1


def test_live_counts(spark, tmp_path):
    logs = events.logs(spark.read.parquet(f"{SF}/events.parquet"))
    logs.select("timestamp", "service", "level").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("timestamp timestamp, service string, level string").parquet(str(tmp_path / "in"))
    query = ingest.live_counts(stream, "1 day").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rollup.coarser(rollup.minutes(logs), "1d")
    assert spark.table("live").exceptAll(want).count() == 0 and want.exceptAll(spark.table("live")).count() == 0


def test_generator_repeats_itself(spark):
    rows = generate.generate(spark, 2000, instant("2026-01-01"))
    assert rows.exceptAll(generate.generate(spark, 2000, instant("2026-01-01"))).count() == 0
    assert rows.select("service").distinct().count() == 4 and rows.agg({"timestamp": "max"}).first()[0] < datetime(2026, 1, 31)
