import pytest
from pyspark.sql import functions as F

from sparklogs.functions.timestamps import instant
from sparklogs.operators import aggregate, rollup
from sparklogs.plans.params import CountParams


def logs(spark, *rows):
    data = [(i, instant(t), level, service, "m", "{}", {}) for i, (t, service, level) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, timestamp timestamp, level string, service string, message string, attributes string, attributes_search map<string,string>")


def ask(frame, since, until, bucket, path="rollup", **more):
    params = CountParams.of(since=since, until=until, bucket=bucket, **more)
    return [(r.start[5:16], r.group, r["count"]) for r in aggregate.counts(frame, rollup.build(frame), params, path).collect()]


@pytest.fixture(scope="module")
def some(spark):
    return logs(
        spark, ("2026-08-15T10:00:10Z", "b", "error"), ("2026-08-15T10:00:50Z", "a", "info"), ("2026-08-15T10:01:00Z", "B", "error"),
        ("2026-08-15T10:04:59.999Z", "é", "warn"), ("2026-08-15T10:05:00Z", "a", "error"), ("2026-08-15T23:59:59Z", "a", "info"), ("2026-08-17T01:30:00Z", "a", "info"),
    )


def test_empty(spark):
    assert ask(logs(spark), "2026-08-15", "2026-08-16", "1h") == []


def test_minutes_and_half_open_range(some):
    assert ask(some, "2026-08-15T10:00Z", "2026-08-15T10:05Z", "1m") == [("08-15T10:00", None, 2), ("08-15T10:01", None, 1), ("08-15T10:04", None, 1)]


def test_five_minutes_lose_nothing(some):
    assert ask(some, "2026-08-15T10:00Z", "2026-08-15T11:00Z", "5m") == [("08-15T10:00", None, 4), ("08-15T10:05", None, 1)]


def test_groups_in_locale_order(some):
    got = ask(some, "2026-08-15T10:00Z", "2026-08-15T10:05Z", "1h", group_by="service")
    assert [g for _, g, _ in got] == ["a", "b", "B", "é"]


def test_filters(some):
    assert ask(some, "2026-08-15", "2026-08-18", "1d", service="a", level="info") == [("08-15T00:00", None, 2), ("08-17T00:00", None, 1)]


@pytest.mark.parametrize("bucket", ["1m", "5m", "1h", "1d"])
@pytest.mark.parametrize("group", [None, "service", "level"])
def test_rollup_is_raw_on_aligned_ranges(some, bucket, group):
    asked = ("2026-08-15T10:01Z", "2026-08-17T01:31Z", bucket)
    assert ask(some, *asked, path="rollup", group_by=group) == ask(some, *asked, path="raw", group_by=group)


def test_unaligned_edges_go_by_minute(some):
    # since inside a minute drops the minute, until inside a minute keeps it; raw counts to the millisecond
    asked = ("2026-08-15T10:00:30Z", "2026-08-15T10:04:30Z", "1h")
    assert ask(some, *asked, path="raw") == [("08-15T10:00", None, 2)]
    assert ask(some, *asked, path="rollup") == [("08-15T10:00", None, 2)]
    asked = ("2026-08-15T10:00:00.001Z", "2026-08-15T10:04:30Z", "5m")
    assert ask(some, *asked, path="raw") == [("08-15T10:00", None, 3)]
    assert ask(some, *asked, path="rollup") == [("08-15T10:00", None, 2)]


def test_routing():
    base = {"since": "2026-01-01", "until": "2026-01-02", "bucket": "1h"}
    assert aggregate.route(CountParams.of(**base)) == "rollup"
    assert aggregate.route(CountParams.of(**base, q="x")) == "raw" == aggregate.route(CountParams.of(**base, attributes={"a": "b"}))


def test_before_1970(spark):
    frame = logs(spark, ("1969-12-31T23:59:59.999Z", "a", "info"))
    assert ask(frame, "1969-12-31", "1970-01-02", "5m", path="raw") == [("12-31T23:55", None, 1)]


def test_prune_keeps_buckets_that_reach_past_the_cutoff(spark):
    frame = logs(spark, ("2025-11-02T04:10:00Z", "a", "info"), ("2025-12-20T17:05:00Z", "a", "info"), ("2025-12-20T17:50:00Z", "a", "info"))
    kept = rollup.pruned(rollup.build(frame), instant("2025-12-20T17:20:00Z"))
    total = lambda part: part.agg(F.sum("count")).first()[0]
    assert (total(kept.minute), total(kept.hour), total(kept.day)) == (1, 2, 2)


def test_deltas_and_reconciliation(some):
    parts = [rollup.minutes(some.where(F.col("id") % 2 == k)) for k in (0, 1)]
    assert rollup.differing(some, rollup.merged(*parts)).count() == 0
    wrong = rollup.differing(some, parts[0])
    assert {(r.raw, r.rolled) for r in wrong.collect()} == {(1, 0)}
