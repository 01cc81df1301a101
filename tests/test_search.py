import pytest

from sparklogs.functions.timestamps import instant
from sparklogs.operators import search
from sparklogs.operators.filters import filtered
from sparklogs.plans.params import Cursor, SearchParams


@pytest.fixture(scope="module")
def logs(spark):
    data = [
        (i, instant(f"2026-08-{15 + i % 3:02d}T10:00:00Z"), "info" if i % 2 else "error", f"s{i % 4}", f"entry {i} 50%_done\\", "{}", {"a.b": str(i % 5)}, instant(f"2026-08-{15 + i % 3:02d}").date())
        for i in range(120)
    ]
    return spark.createDataFrame(data, "id long, timestamp timestamp, level string, service string, message string, attributes string, attributes_search map<string,string>, dt date")


def test_pages_are_the_whole_result(logs):
    params, got = SearchParams.of(limit=17), []
    while True:
        page = search.fetch(logs, params)
        got += [int(r.id) for r in page.rows]
        if page.next_cursor is None:
            break
        params = SearchParams.of(limit=17, cursor=page.next_cursor)
    want = sorted(range(120), key=lambda i: (i % 3, i), reverse=True)
    assert got == want
    assert sorted(int(r.id) for r in search.walk(logs, SearchParams.of(limit=17), 3).collect()) == sorted(want[:51])


def test_report_agrees_with_fetch(logs):
    for limit in (50, 120, 1000):
        report = search.page_report(logs, SearchParams.of(limit=limit)).first()
        page = search.fetch(logs, SearchParams.of(limit=limit))
        assert (report.rows, report.next_cursor) == (len(page.rows), page.next_cursor)
    assert search.page_report(logs.where("id < 0"), SearchParams.of()).first() == (0, None)


def test_filters(logs):
    count = lambda **f: filtered(logs, **f).count()
    assert count(service="s1") == 30 and count(service="S1") == 0 and count(level="") == 120
    assert count(attributes={"a.b": "3"}) == 24 and count(attributes={"a.b": "3", "x": "1"}) == 0
    assert count(q="ENTRY 1_ ") == 10 and count(q=r"50\%\_done") == 120 and count(q="50%done") == 120 and count(q="done\\") == 0
    assert count(q_literal="50%_DONE\\") == 120
    assert count(since=instant("2026-08-16T10:00:00Z"), until=instant("2026-08-17T10:00:00Z")) == 40


def test_plan_is_a_top_k_over_pruned_dates(spark, logs, tmp_path):
    logs.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    params = SearchParams(since=instant("2026-08-16"), limit=5, cursor=Cursor(instant("2026-08-17T10:00:00Z"), 7))
    plan = search.page(table, params)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Sort [" not in plan
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
