import base64
import json

import pytest

from sparklogs.functions.attributes import number_text
from sparklogs.functions.patterns import like_pattern
from sparklogs.functions.timestamps import instant
from sparklogs.plans.params import CountParams, Cursor, SearchParams

RANGE = {"since": "2026-07-20T14:00:00Z", "until": "2026-07-20T15:00:00Z"}


def cursor(**raw):
    return base64.b64encode(json.dumps(raw).encode()).decode()


def test_search_defaults():
    p = SearchParams.of()
    assert (p.limit, p.cursor, p.attributes, p.level) == (100, None, {}, None)


@pytest.mark.parametrize("limit", [1, 100, 1000, "250"])
def test_good_limits(limit):
    assert SearchParams.of(limit=limit).limit == int(limit)


@pytest.mark.parametrize("limit, message", [(0, "between"), (-1, "between"), (1001, "between"), (5000, "between"), ("abc", "integer"), (1.5, "integer"), ("nan", "integer")])
def test_bad_limits(limit, message):
    with pytest.raises(ValueError, match=message):
        SearchParams.of(limit=limit)


@pytest.mark.parametrize(
    "given, message",
    [
        ({"level": "ERROR"}, "Unsupported log level"),
        ({"since": "x"}, 'Invalid timestamp for "since"'),
        ({"until": "x"}, 'Invalid timestamp for "until"'),
        ({"since": "2026-01-02", "until": "2026-01-01"}, '"until" cannot be earlier'),
        ({"cursor": "!!"}, "Invalid or malformed cursor"),
        ({"cursor": base64.b64encode(b"{").decode()}, "Invalid or malformed cursor"),
        ({"cursor": cursor(timestamp=1, id=2)}, "Malformed cursor structure"),
        ({"cursor": cursor(timestamp="2026-01-01T00:00:00Z", id="2")}, "Malformed cursor structure"),
        ({"cursor": cursor(timestamp="x", id=2)}, "Malformed cursor structure"),
        ({"attributes": {"k": ["a", "b"]}}, "attribute values"),
    ],
)
def test_bad_searches(given, message):
    with pytest.raises(ValueError, match=message):
        SearchParams.of(**given)


def test_equal_bounds_and_cursor():
    p = SearchParams.of(since="2026-01-01", until="2026-01-01", cursor=cursor(timestamp="2026-01-01T00:00:00.123Z", id=2**60 + 1))
    assert p.cursor == Cursor(instant("2026-01-01T00:00:00.123Z"), 2**60 + 1)


@pytest.mark.parametrize(
    "given, message",
    [
        ({"since": None}, "Missing required"),
        ({"bucket": None}, "Missing required"),
        ({"level": "fatal"}, "Unsupported log level"),
        ({"since": "x"}, "Invalid date format"),
        ({"until": "2026-07-20T13:00:00Z"}, "must not be earlier"),
        ({"bucket": "2m"}, "Invalid bucket value"),
        ({"group_by": "timestamp"}, "Invalid group_by"),
    ],
)
def test_bad_counts(given, message):
    with pytest.raises(ValueError, match=message):
        CountParams.of(**({"bucket": "1m"} | RANGE | given))


def test_counts_fold_case_and_drop_empty_keys():
    p = CountParams.of(**RANGE, bucket="5m", level="ERROR", group_by="Service", attributes={"": "x", "a.b": "y"})
    assert (p.level, p.group_by, p.attributes) == ("error", "service", {"a.b": "y"})


@pytest.mark.parametrize("number, text", [("3.0", "3"), ("1e3", "1000"), ("1e21", "1" + "0" * 21), ("1e-7", "0.0000001"), ("-0.0", "0"), ("9007199254740993", "9007199254740992"), ("0.1", "0.1"), ("-12.50", "-12.5")])
def test_number_text(number, text):
    assert number_text(number) == text


@pytest.mark.parametrize("q, pattern", [("a%b", "%a%b%"), (r"50\%", r"%50\%%"), (r"a\b", "%ab%"), ("a\\", "%a\\%"), (r"\\", r"%\\%"), ("_", "%_%")])
def test_like_pattern(q, pattern):
    assert like_pattern(q) == pattern
