import json

import pytest
from pyspark.sql import functions as F

from sparklogs.functions.timestamps import instant, iso
from sparklogs.operators import validate
from sparklogs.sources import workdir

AS_OF = instant("2026-08-15T12:00:00Z")
GOOD = {"timestamp": "2026-08-15T09:41:07Z", "level": "warn", "service": "ledger", "message": "retry scheduled", "attributes": {"tenant": "n7", "attempt": 2, "urgent": False}}


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "batch_id long, body string")


def batch(spark, *entries):
    raw = ",".join(e if isinstance(e, str) and e.startswith("raw:") else json.dumps(e) for e in entries).replace("raw:", "")
    return validate.validated(validate.exploded(bodies(spark, '{"logs":[' + raw + "]}")), AS_OF)


def reasons(spark, *entries):
    return [r.reason for r in batch(spark, *entries).orderBy("index").collect()]


CASES = [
    (GOOD, None),
    ("text", validate.NOT_OBJECT),
    ([GOOD], validate.NOT_OBJECT),
    (None, validate.NOT_OBJECT),
    (5, validate.NOT_OBJECT),
    ({k: v for k, v in GOOD.items() if k != "timestamp"}, validate.NO_TIMESTAMP),
    (GOOD | {"timestamp": 5}, validate.NO_TIMESTAMP),
    (GOOD | {"timestamp": "  ﻿"}, validate.NO_TIMESTAMP),
    (GOOD | {"timestamp": "not-a-date"}, validate.BAD_TIMESTAMP),
    (GOOD | {"timestamp": "12:30"}, validate.BAD_TIMESTAMP),
    (GOOD | {"timestamp": "2026-02-30"}, validate.BAD_TIMESTAMP),
    (GOOD | {"timestamp": "2026-08-15T12:10:00Z"}, validate.FUTURE),
    (GOOD | {"timestamp": "2026-08-15T12:04:00Z"}, None),
    (GOOD | {"timestamp": "2026-08-15T12:05:00.000Z"}, None),
    (GOOD | {"level": "critical"}, "invalid level: 'critical'"),
    (GOOD | {"level": "ERROR"}, "invalid level: 'ERROR'"),
    ({k: v for k, v in GOOD.items() if k != "level"}, "invalid level: 'undefined'"),
    (GOOD | {"level": None}, "invalid level: 'null'"),
    (GOOD | {"level": 7}, "invalid level: '7'"),
    (GOOD | {"level": {"a": 1}}, "invalid level: '[object Object]'"),
    (GOOD | {"level": ["a", None, 1]}, "invalid level: 'a,,1'"),
    (GOOD | {"service": "   "}, validate.NO_SERVICE),
    (GOOD | {"service": 1}, validate.NO_SERVICE),
    (GOOD | {"message": ""}, validate.NO_MESSAGE),
    (GOOD | {"attributes": [1]}, validate.NOT_FLAT),
    (GOOD | {"attributes": "x"}, validate.NOT_FLAT),
    (GOOD | {"attributes": None}, None),
    (GOOD | {"attributes": {"a": {"b": 1}}}, "nested objects or arrays are not allowed in attribute: 'a'"),
    (GOOD | {"attributes": {"tags": [1]}}, "nested objects or arrays are not allowed in attribute: 'tags'"),
    (GOOD | {"timestamp": "x", "level": "y", "service": ""}, validate.BAD_TIMESTAMP),
    (GOOD | {"service": "", "attributes": [1]}, validate.NO_SERVICE),
]


def test_reasons(spark):
    assert reasons(spark, *[c for c, _ in CASES]) == [r for _, r in CASES]


@pytest.fixture(scope="module")
def rows(spark):
    entries = [
        GOOD | {"attributes": {"user_id": "42", "ignored": None}},
        GOOD | {"attributes": {'weird "key"': 'a "b" \\ \n'}},
        'raw:{"timestamp":"2026-08-15T10:00:00.123999+02:00","level":"info","service":" s ","message":"m","attributes":{"a":3.0,"b":1e3,"c":1e21,"d":1e-7,"e":true,"f":3,"f":4}}',
        'raw:{"timestamp":"2026-08-14T24:00:00Z","level":"info","service":"s","message":"m"}',
        GOOD | {"timestamp": "2026-08"},
    ]
    return validate.accepted(batch(spark, *entries)).withColumn("iso", iso(F.col("timestamp"))).orderBy("index").collect()


def test_nulls_are_dropped(rows):
    assert json.loads(rows[0].attributes) == {"user_id": "42"} == rows[0].attributes_search


def test_special_characters(rows):
    assert json.loads(rows[1].attributes) == {'weird "key"': 'a "b" \\ \n'} == rows[1].attributes_search


def test_numbers_and_duplicates(rows):
    assert rows[2].attributes_search == {"a": "3", "b": "1000", "c": "1" + "0" * 21, "d": "0.0000001", "e": "true", "f": "4"}
    assert json.loads(rows[2].attributes) == {"a": 3.0, "b": 1e3, "c": 1e21, "d": 1e-7, "e": True, "f": 4}


def test_times(rows):
    assert [r.iso for r in rows[2:]] == ["2026-08-15T08:00:00.123Z", "2026-08-15T00:00:00.000Z", "2026-08-01T00:00:00.000Z"]
    assert rows[2].service == " s " and rows[3].attributes == "{}"


def test_report(spark):
    checked = batch(spark, GOOD, GOOD | {"level": "bogus"}, GOOD)
    r = validate.report(checked).first()
    assert (r.accepted, [tuple(x) for x in r.rejected], r.status) == (2, [(1, "invalid level: 'bogus'")], 200)
    assert validate.report(batch(spark, "a", "b")).first().status == 400


def test_envelopes(spark):
    texts = {
        '{"logs":[1]}': None, '{"logs": [': validate.MALFORMED, "": validate.MALFORMED, '{"logs":[1]} trailing': validate.MALFORMED,
        '{"logs":[1]} {"a":1}': validate.MALFORMED, "5": validate.MALFORMED, "[]": validate.NO_LOGS, '{"logs":5}': validate.NO_LOGS, "{}": validate.NO_LOGS,
        '{"logs":null}': validate.NO_LOGS, '{"logs":[]}': validate.EMPTY, ' {"logs":[{}]} \n': None,
        '{"logs":["' + "x" * validate.BODY_LIMIT + '"]}': validate.TOO_LARGE, '{"logs":[],"logs":[1]}': None,
    }
    got = {r.batch_id: r.outcome for r in validate.envelopes(bodies(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_ids_follow_batch_and_index(spark):
    rows = spark.createDataFrame([(b, i) for b in (5000, 3, 999, 1000) for i in (1, 0)], "batch_id long, index int")
    got = {(r.batch_id, r["index"]): r.id for r in validate.with_ids(rows, 10).collect()}
    assert [got[k] for k in sorted(got)] == list(range(11, 19))


def test_ids_of_rows_without_or_with_sparse_batches(spark, monkeypatch):
    """No row is lost, nulls come last, and no range holds more than twice its share."""
    monkeypatch.setattr(validate, "RANGE_ROWS", 2_000)
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id = 1 THEN 1000000000000 ELSE id END AS batch_id", "CAST(id % 2 AS INT) AS index", "id AS came")
    stored, offsets, count = validate.ranges(rows, f"{workdir.fresh(spark, 'ranges')}")
    assert count == 20_000
    sizes = [r["count"] for r in stored.groupBy(F.shiftright("at_", 33).alias("r")).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 20_000 / 10
    out = validate.placed(stored, offsets, 5).orderBy("id").collect()
    assert [r.id for r in out] == list(range(6, 20_006))
    assert [(r.batch_id is None, r.batch_id or 0, r["index"]) for r in out] == sorted((r.batch_id is None, r.batch_id or 0, r["index"]) for r in out)
    assert len({r.came for r in out}) == 20_000
    assert validate.with_ids(rows.limit(0)).count() == 0
