from pathlib import Path

import pytest

from sparklogs.functions.timestamps import instant
from sparklogs.operators import filters, reconcile, rollup, rollup_store, validate
from sparklogs.plans import queries
from sparklogs.schema import LOGS
from sparklogs.sources import bodies, events, store
from sparklogs.sources.manifest import Table
from sparklogs.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return events.logs(spark.read.parquet(f"{SF}/events.parquet"))


def scanned(frame):
    """Rows that the scan of a plan without a shuffle gave, after it ran."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_promoted_attributes_skip_pages_and_row_groups(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    rows = logs.selectExpr("id", "timestamp", "level", "service", "message", "attributes", "map('k', attributes_search['k'], 'j', CAST(id % 97 AS STRING)) AS attributes_search", "DATE'2024-01-02' AS dt")
    store.write(rows.coalesce(1), path, promote=["k", "j"], **{"parquet.page.row.count.limit": "50", "parquet.block.size": "20000"})
    plain, fast = store.read(spark, path), store.read(spark, path, ["k", "j"])
    for attributes in ({"k": "7"}, {"j": "12"}, {"k": "7", "j": "12"}, {"k": "none"}):
        a, b = (filters.filtered(t, attributes=attributes) for t in (plain, fast))
        assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert scanned(filters.filtered(plain, attributes={"k": "7"})) == 1000
    assert scanned(filters.filtered(fast, attributes={"k": "7"})) < 300  # sorted by k: some pages
    assert scanned(filters.filtered(fast, attributes={"k": "none"})) == 0
    plan = filters.filtered(fast, attributes={"k": "7"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attr_k,7)" in plan
    with pytest.raises(ValueError):
        store.write(rows, path, promote=["a.b"])


def test_reconciliation_reads_only_what_differs(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    table = Table(spark, path)
    for k in range(2):
        some = logs.where(f"id % 2 = {k}").select(*LOGS.fieldNames())
        parts = table.write(store.spread(some), "rows", by_date=True)
        parts += reconcile.write(table, some) + rollup_store.deltas(table, rollup.minutes(some))
        table.commit(lambda v, parts=parts, k=k: v.plus(parts, k))
    assert reconcile.differing_hours(spark, path) == [] and reconcile.differing(spark, path).count() == 0
    # a row too many in one hour, and two that change places in another: its count stays
    swap = logs.where("dt = '2024-01-09'").limit(1)
    wrong = logs.where("dt = '2024-01-05'").limit(1).unionByName(swap.selectExpr("id", "timestamp", "level", "'other' AS service", "message", "attributes", "attributes_search", "dt"))
    minus = rollup.minutes(swap).selectExpr("bucket_start", "service", "level", "-count AS count")
    parts = rollup_store.deltas(table, rollup.minutes(wrong).unionByName(minus))
    table.commit(lambda v: v.plus(parts, 2))
    assert len(reconcile.differing_hours(spark, path)) == 2
    for day in Path(path, "rows").glob("part=*/dt=*"):
        if day.name not in ("dt=2024-01-05", "dt=2024-01-09"):
            for file in day.glob("*.parquet"):
                file.write_bytes(b"not to be read")
    got = {(r.service, r.raw, r.rolled) for r in reconcile.differing(spark, path).collect()}
    assert len(got) == 3 and ("other", 0, 1) in got
    assert reconcile.differing_hours(spark, path, instant("2024-01-10")) == []


def test_digests_follow_compaction_and_expiry(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = events.bodies(spark.read.parquet(f"{SF}/events.parquet"), queries.AS_OF)
    for k in range(2):
        ingest.ingest_epoch(rows.where(f"batch_id % 2 = {k}"), k, path, lambda: queries.AS_OF)
    assert reconcile.differing_hours(spark, path) == []
    ingest.compact(spark, path)
    digests = Table(spark, path).version().of(reconcile.SECTION)
    assert len(digests) == len({p.dt for p in digests}) and reconcile.differing_hours(spark, path) == []
    ingest.expire(spark, path, instant("2024-01-16T13:37:00Z"))
    assert reconcile.differing_hours(spark, path, instant("2024-01-16T14:00:00Z")) == []
    assert min(p.dt for p in Table(spark, path).version().of(reconcile.SECTION)) == "2024-01-16"


def test_bodies_from_text(spark, tmp_path):
    top = tmp_path / "files"
    top.mkdir()
    good = '{"logs":[{"timestamp":"2024-01-01T00:00:00Z","level":"info","service":"é","message":"line\\nbreak"}]}'
    texts = {"a.json": good, "b.json": "{", "c.json": "", "d.json": good + " " * validate.BODY_LIMIT, "e.json": good.replace(",", ",\n")}
    for name, text in texts.items():
        (top / name).write_text(text)
    (top / "f.json").write_bytes(b"\xff\xfe")
    (top / "g.json").write_text(good + " " * (validate.BODY_LIMIT - len(good.encode())))
    read = bodies.whole(spark, str(top))
    got = {Path(r.batch_id).name: r.outcome for r in validate.envelopes(read).collect()}
    assert got == {"a.json": None, "b.json": validate.MALFORMED, "d.json": validate.TOO_LARGE, "e.json": None, "f.json": validate.MALFORMED, "g.json": None}
    assert {r.body is None for r in read.where(f"size > {validate.BODY_LIMIT}").collect()} == {True}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(length,{validate.BODY_LIMIT})" in plan
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text(good + "\n\n{\r\n" + good)
    rows = {r.batch_id.rsplit("/", 1)[1]: r.outcome for r in validate.envelopes(bodies.lines(spark, str(lines))).collect()}
    assert rows == {"x.jsonl#1": None, "x.jsonl#3": validate.MALFORMED, "x.jsonl#4": None}
    checked = validate.validated(validate.exploded(bodies.lines(spark, str(lines))), queries.AS_OF)
    assert validate.with_ids(validate.accepted(checked)).count() == 2
