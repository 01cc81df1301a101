from datetime import timedelta
from pathlib import Path

import pytest

from sparklogs.functions.timestamps import instant
from sparklogs.operators import recent, search
from sparklogs.plans.params import Cursor, SearchParams
from sparklogs.schema import LOGS
from sparklogs.sources import events, store
from sparklogs.sources.manifest import Table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return events.logs(spark.read.parquet(f"{SF}/events.parquet")).select(*LOGS.fieldNames())


@pytest.fixture(scope="module")
def places(spark, logs, tmp_path_factory):
    """The logs in a plain folder and in a table with versions."""
    top = tmp_path_factory.mktemp("recent")
    store.write(logs, str(top / "plain"))
    table = Table(spark, str(top / "table"))
    for k in range(2):
        parts = table.write(logs.where(f"id % 2 = {k}"), "rows", by_date=True)
        table.commit(lambda v, parts=parts, k=k: v.plus(parts, k))
    return top


def both(spark, places):
    return recent.of_folder(spark, str(places / "plain")), recent.of_table(spark, str(places / "table"))


CASES = [
    SearchParams(limit=5), SearchParams(limit=100), SearchParams(limit=1000), SearchParams(limit=20, level="error"), SearchParams(limit=7, q="click", service="auth"),
    SearchParams(limit=50, since=instant("2024-01-05T09:45:30.500Z"), until=instant("2024-01-12T12:20:15.250Z")), SearchParams(limit=10, cursor=Cursor(instant("2024-01-20T12:00:00Z"), 600)),
    SearchParams(limit=10, until=instant("2023-01-01")), SearchParams(limit=3, attributes={"k": "no such value"}), SearchParams(limit=40, until=instant("2024-01-30T00:00:01Z")),
]


@pytest.mark.parametrize("params", CASES)
def test_same_page_as_a_full_scan(spark, logs, places, params):
    want = search.fetch(logs, params)
    for dates in both(spark, places):
        got, _ = recent.fetch(dates, params)
        assert [tuple(r) for r in got.rows] == [tuple(r) for r in want.rows] and got.next_cursor == want.next_cursor


def test_only_the_newest_dates_are_read(spark, logs, places):
    plain, table = both(spark, places)
    newest = sorted(table.rows, reverse=True)
    assert list(table.rows) == newest and sum(table.rows.values()) == 1000 and set(plain.rows.values()) == {None}
    need, sure = 100, 0
    while sum(table.rows[d] for d in newest[:sure]) < need + 1:
        sure += 1
    assert recent.fetch(table, SearchParams(limit=need))[1] == newest[:sure]  # told by the numbers of rows, in one step
    assert recent.fetch(plain, SearchParams(limit=5))[1] == newest[:1]
    assert len(recent.fetch(plain, SearchParams(limit=need))[1]) <= 2 * sure + 1
    assert recent.fetch(table, SearchParams(limit=3, attributes={"k": "no such value"}))[1] == newest  # a rare value reads on
    assert recent.fetch(table, SearchParams(limit=5, until=instant(str(newest[9])) + timedelta(hours=1)))[1][0] == newest[9]


def test_older_files_are_not_opened(spark, logs, tmp_path):
    store.write(logs, str(tmp_path / "t"))
    days = sorted(Path(tmp_path / "t").glob("dt=*"))
    for day in days[:-3]:
        for file in day.glob("*.parquet"):
            file.write_bytes(b"not Parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    page, seen = recent.fetch(recent.of_folder(spark, str(tmp_path / "t")), SearchParams(limit=40))
    assert len(page.rows) == 40 and len(seen) <= 3
    with pytest.raises(Exception, match="not Parquet|not a Parquet|CANNOT_READ|FAILED_READ"):
        search.fetch(store.read(spark, str(tmp_path / "t")), SearchParams(limit=40))


def test_walk_is_gapless(spark, logs, places):
    rows, seen = recent.walk(both(spark, places)[1], SearchParams(limit=90), 4)
    assert [r.id for r in rows] == [r.id for r in search.page(logs, SearchParams(limit=360)).collect()]
    assert len(seen) == 4 and max(map(len, seen)) < 8
