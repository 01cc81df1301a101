"""The same queries as SQL for DuckDB, written on their own terms."""

from __future__ import annotations

_LOGS = """
L AS (
  SELECT event_id AS id, date_trunc('milliseconds', ts) AS ts,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         CASE user_id % 4 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth' WHEN 2 THEN 'payment' ELSE 'inventory' END AS service,
         event_type || ' by user ' || user_id AS message, props AS attributes, json_extract_string(props, '$.k') AS k
  FROM events
)"""
_SHAPE = "id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message, attributes"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_A0, _A1 = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-12 00:00:00'"
_U0, _U1 = "TIMESTAMP '2024-01-05 09:45:30.500'", "TIMESTAMP '2024-01-12 12:20:15.250'"
_BUCKETS = {
    "1m": "date_trunc('minute', ts)", "5m": "time_bucket(INTERVAL '5 minutes', ts)", "1h": "date_trunc('hour', ts)", "1d": "date_trunc('day', ts)",
}


def _filter(where: str) -> str:
    return f"WITH {_LOGS} SELECT {_SHAPE} FROM L WHERE {where}"


def _page(where: str, limit: int, hourly: bool = False) -> str:
    source = "(SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM L)" if hourly else "L"
    return f"WITH {_LOGS} SELECT {_SHAPE} FROM (SELECT * FROM {source} WHERE {where} ORDER BY ts DESC, id DESC LIMIT {limit})"


def _count(bucket: str, since: str, until: str, group: str | None = None, where: str = "true", tested: str = "ts") -> str:
    start, shown = _ISO.format(_BUCKETS[bucket]), group or "CAST(NULL AS VARCHAR)"
    return f"""WITH {_LOGS} SELECT {start} AS start, {shown} AS "group", count(*) AS count
FROM L WHERE {tested} >= {since} AND {tested} < {until} AND {where} GROUP BY ALL"""


def _rolled(bucket: str, since: str, until: str, group: str | None = None) -> str:
    return _count(bucket, since, until, group, tested="date_trunc('minute', ts)")


def _rollup(width: str, where: str = "true", extra: str = "") -> str:
    return f"""SELECT {_ISO.format(f"date_trunc('{width}', ts)")} AS start, service, level, count(*) AS count{extra}
FROM L WHERE {where} GROUP BY date_trunc('{width}', ts), service, level"""


_ENTRIES = f"""{_LOGS}, B AS (
  SELECT *, id // 50 AS batch_id, id % 50 AS idx,
    CASE WHEN (id // 50) % 31 = 0 THEN 'Malformed JSON payload'
         WHEN (id // 50) % 29 = 0 THEN 'Invalid request structure: must contain ''logs'' array'
         WHEN (id // 50) % 23 = 0 THEN 'logs array must contain at least one log entry' END AS outcome,
    CASE WHEN id % 97 = 0 THEN 'log entry must be a valid object'
         WHEN id % 89 = 0 THEN 'invalid timestamp: must be a non-empty ISO 8601 string'
         WHEN id % 83 = 0 THEN 'invalid timestamp format: must be valid ISO 8601'
         WHEN id % 79 = 0 THEN 'timestamp cannot be more than 5 minutes in the future'
         WHEN id % 73 = 0 THEN 'invalid level: ''' || (CASE id // 73 % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'ERROR' WHEN 2 THEN '7' ELSE 'undefined' END) || ''''
         WHEN id % 71 = 0 THEN 'service must be a non-empty string'
         WHEN id % 67 = 0 THEN 'message must be a non-empty string'
         WHEN id % 61 = 0 THEN 'attributes must be a flat object'
         WHEN id % 59 = 0 THEN 'nested objects or arrays are not allowed in attribute: ''tags''' END AS reason
  FROM L
), E AS (
  SELECT * REPLACE (CASE WHEN id % 53 <> 0 AND id % 47 = 0 THEN '{{}}' ELSE '{{"k":' || k || '}}' END AS attributes,
                    CASE WHEN id % 53 <> 0 AND id % 47 = 0 THEN NULL ELSE k END AS k)
  FROM B WHERE outcome IS NULL
)"""
_STORED = f"{_ISO.format('ts')} AS timestamp, level, service, message, attributes, k"
_CUT_INSIDE = "TIMESTAMP '2024-01-16 13:37:00'"

_REPORT = f"""WITH {_ENTRIES} SELECT batch_id, count(*) FILTER (reason IS NULL) AS accepted,
coalesce(string_agg(idx || ':' || reason, ';' ORDER BY idx) FILTER (reason IS NOT NULL), '') AS rejected,
CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 400 ELSE 200 END AS status FROM E GROUP BY batch_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "logs_projection": f"WITH {_LOGS} SELECT {_SHAPE}, k FROM L",
        "filter_service": _filter("service = 'auth'"),
        "filter_level": _filter("level = 'error'"),
        "filter_time_range": _filter(f"ts >= {_U0} AND ts < {_U1}"),
        "filter_q": _filter(r"message ILIKE '%PURCHASE by%' ESCAPE '\'"),
        "filter_q_wildcard": _filter("message ILIKE '%p_rchase%user 1_%'"),
        "filter_q_literal": _filter("contains(lower(message), 'error by user 1')"),
        "filter_attr": _filter("k = '7'"),
        "filter_attr_promoted": _filter("k = '7'"),
        "filter_combined": _filter(f"service = 'payment' AND level = 'info' AND ts >= {_A0} AND ts < {_A1} AND message ILIKE '%click%' AND k = '3'"),
        "search_first_page": _page("true", 50),
        "search_next_page": _page("(ts, id) < (TIMESTAMP '2024-01-20 12:00:00', 6000)", 50, hourly=True),
        "search_filtered_page": _page("service = 'inventory' AND level = 'warn'", 25),
        "search_descending": f"""WITH {_LOGS} SELECT {_SHAPE}, search FROM (
  (SELECT *, '0' AS search FROM L ORDER BY ts DESC, id DESC LIMIT 2000)
  UNION ALL (SELECT *, '1' FROM L WHERE service = 'payment' AND level = 'error' AND k = '9' ORDER BY ts DESC, id DESC LIMIT 30)
  UNION ALL (SELECT *, '2' FROM L WHERE ts >= {_U0} AND ts < {_U1} AND (ts, id) < (TIMESTAMP '2024-01-11 12:00:00', 1) ORDER BY ts DESC, id DESC LIMIT 300))""",
        "search_page_report": f"""WITH {_LOGS}, P AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS n FROM L)
SELECT least(count(*), 50)::BIGINT AS rows, CASE WHEN count(*) > 50 THEN
  (SELECT to_base64(('{{"timestamp":"' || {_ISO.format('ts')} || '","id":' || id || '}}')::BLOB) FROM P WHERE n = 50) END AS next_cursor
FROM P WHERE n <= 51""",
        "search_page_walk": _page("level = 'error'", 160, hourly=True),
        "agg_1m": _count("1m", _U0, _U1),
        "agg_5m": _count("5m", _U0, _U1),
        "agg_1h": _count("1h", _U0, _U1),
        "agg_1d": _count("1d", _U0, _U1),
        "agg_1h_by_service": _count("1h", _A0, _A1, "service"),
        "agg_1d_by_level": _count("1d", _U0, _U1, "level"),
        "agg_1h_q": _count("1h", _U0, _U1, where="message ILIKE '%by user 1%'"),
        "agg_1h_attr": _count("1h", _U0, _U1, where="k = '5'"),
        "agg_5m_filtered": _count("5m", _A0, _A1, "level", "service = 'checkout' AND level = 'error'"),
        "rollup_minute": f"WITH {_LOGS} {_rollup('minute')}",
        "rollup_hour": f"WITH {_LOGS} {_rollup('hour')}",
        "rollup_day": f"WITH {_LOGS} {_rollup('day')}",
        "rollup_query_1m": _rolled("1m", _U0, _U1),
        "rollup_query_5m": _rolled("5m", _U0, _U1, "service"),
        "rollup_query_1h_unaligned": _rolled("1h", _U0, _U1, "level"),
        "rollup_query_1d_by_service": _rolled("1d", _U0, _U1, "service"),
        "rollup_query_narrow": _rolled("1h", _U0, "TIMESTAMP '2024-01-05 10:10:00'"),
        "rollup_incremental": f"WITH {_LOGS} {_rollup('minute')}",
        "rollup_reconcile": "SELECT 0::BIGINT AS differing, count(*) AS rolled, count(*) AS raw FROM events",
        "rollup_reconcile_differing": f"""WITH {_LOGS} SELECT {_ISO.format("date_trunc('minute', ts)")} AS start, service, level, count(*) AS raw,
count(*) FILTER (id % 501 <> 7) + count(*) FILTER (id % 1009 = 3) AS rolled
FROM L GROUP BY date_trunc('minute', ts), service, level HAVING raw <> rolled""",
        "ingest_validate": f"WITH {_ENTRIES} SELECT batch_id, idx AS index, reason FROM E",
        "ingest_batch_report": _REPORT,
        "ingest_envelope": f"WITH {_ENTRIES} SELECT DISTINCT batch_id, outcome FROM B",
        "ingest_accepted": f"WITH {_ENTRIES} SELECT row_number() OVER (ORDER BY batch_id, idx) AS id, {_STORED} FROM E WHERE reason IS NULL",
        "ingest_ids_sparse": f"""WITH {_ENTRIES}, S AS (
  SELECT CASE WHEN batch_id % 7 = 3 THEN NULL WHEN batch_id % 11 = 5 THEN batch_id * 1000000000000 ELSE batch_id END AS batch_id, idx FROM E WHERE reason IS NULL
) SELECT row_number() OVER (ORDER BY batch_id NULLS LAST, idx) AS id, batch_id, idx AS index FROM S""",
        "ingest_envelope_text": f"""WITH {_ENTRIES}, D AS (SELECT DISTINCT batch_id, outcome FROM B)
SELECT NULL::BIGINT AS batch, outcome, count(*) AS bodies FROM D GROUP BY outcome
UNION ALL SELECT batch_id, outcome, 1 FROM D WHERE batch_id % 10 = 1 OR batch_id % 23 = 0
UNION ALL SELECT -1, 'Request body exceeds the maximum allowed size', 1""",
        "unnest_batches": f"WITH {_LOGS} SELECT id // 50 AS batch_id, {_ISO.format('ts')} AS timestamp, level, service, message, attributes FROM L",
        "copy_text": r"""SELECT '2024-01-31T00:00:00.000Z' || chr(9) || lang || chr(9) || source || chr(9)
|| replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') || chr(9) || '{}' AS line FROM documents""",
        "retention_keep": _filter("ts >= TIMESTAMP '2024-01-16 00:00:00'"),
        "retention_deleted_by_day": f"WITH {_LOGS} SELECT ts::DATE::VARCHAR AS dt, count(*) AS deleted FROM L WHERE ts < {_CUT_INSIDE} GROUP BY 1",
        "retention_apply": _filter(f"ts >= {_CUT_INSIDE}"),
        "rollup_pruned": f"""WITH {_LOGS} SELECT * FROM ({' UNION ALL '.join(
            _rollup(w, f"date_trunc('{w}', ts) + INTERVAL 1 {w} > {_CUT_INSIDE}", f", '{n}' AS width") for w, n in (('minute', '1m'), ('hour', '1h'), ('day', '1d')))})""",
        "stream_ingest": f"WITH {_ENTRIES} SELECT {_STORED} FROM E WHERE reason IS NULL",
        "stream_rollup": f"WITH {_ENTRIES} {_rollup('minute', 'reason IS NULL').replace('FROM L', 'FROM E')}",
        "rollup_store_query": _rolled("1h", _U0, _U1, "level"),
        "rollup_compacted": f"""WITH {_LOGS} SELECT * FROM ({' UNION ALL '.join(
            _rollup(w, "true", f", '{n}' AS width") for w, n in (('minute', '1m'), ('hour', '1h'), ('day', '1d')))})""",
        "rollup_late_epoch": f"""WITH {_LOGS} SELECT * FROM ({' UNION ALL '.join(
            _rollup(w, "true", f", '{n}' AS width") for w, n in (('minute', '1m'), ('hour', '1h'), ('day', '1d')))})""",
        "agg_in_order": f"""SELECT row_number() OVER (ORDER BY start, "group") AS place, * FROM (
SELECT start, "group", count FROM ({_count("1h", _A0, _A1, "service")}))""",
        "agg_routed": f"""SELECT *, 'rollup' AS path FROM ({_rolled("1d", _U0, _U1, "service")})
UNION ALL SELECT *, 'raw' AS path FROM ({_count("1d", _U0, _U1, "service", where="message ILIKE '%user 1%'")})""",
        "search_cursor_page": f"WITH {_LOGS} SELECT {_SHAPE} FROM (SELECT * FROM L ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 50)",
        "stream_report": _REPORT,
        "stream_expired": f"""WITH {_ENTRIES} SELECT *, 'rows' AS of FROM ({_rollup('day', f"reason IS NULL AND ts >= {_CUT_INSIDE}").replace('FROM L', 'FROM E')})
UNION ALL SELECT *, 'rollup' AS of FROM ({_rollup('day', f"reason IS NULL AND date_trunc('day', ts) + INTERVAL 1 day > {_CUT_INSIDE}").replace('FROM L', 'FROM E')})""",
        "stream_live_counts": f"WITH {_LOGS} {_rollup('hour')}",
        "stream_live_bounded": f"WITH {_LOGS} {_rollup('day', "ts >= TIMESTAMP '2024-01-21 00:00:00'")}",
        "stream_compacted": f"WITH {_ENTRIES} SELECT {_STORED} FROM E WHERE reason IS NULL",
        "stream_late": f"WITH {_ENTRIES} {_rollup('day', 'reason IS NULL').replace('FROM L', 'FROM E')}",
        "parameters_checked": """SELECT event_type, user_id % 7 AS kind, count(*) AS events,
CASE user_id % 7 WHEN 0 THEN 'Limit must be between 1 and 1000' WHEN 1 THEN CASE event_type WHEN 'error' THEN 'accepted' ELSE 'Unsupported log level' END
  WHEN 2 THEN 'Limit must be a valid integer' WHEN 3 THEN 'Unsupported log level' WHEN 4 THEN 'Invalid timestamp for "since"'
  WHEN 5 THEN '"until" cannot be earlier than "since"' ELSE 'Invalid or malformed cursor' END AS search,
CASE user_id % 7 WHEN 0 THEN 'Missing required parameters: since, until, and bucket are required'
  WHEN 1 THEN CASE event_type WHEN 'error' THEN 'accepted' ELSE 'Unsupported log level' END WHEN 2 THEN 'Invalid bucket value. Allowed: 1m, 5m, 1h, 1d'
  WHEN 3 THEN 'Invalid group_by. Allowed: service, level' WHEN 4 THEN 'Invalid date format for since or until'
  WHEN 5 THEN '''until'' must not be earlier than ''since''' ELSE 'accepted' END AS counts FROM events GROUP BY ALL""",
        "generate_logs": """SELECT event_id AS id,
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 7919 % 2592000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
CASE event_id * 31 % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' ELSE 'error' END AS level,
CASE event_id * 17 % 7 % 4 WHEN 0 THEN 'checkout' WHEN 1 THEN 'auth' WHEN 2 THEN 'payment' ELSE 'inventory' END AS service,
'entry ' || event_id AS message,
'{"retries":' || event_id % 5 || ',"region":"eu-west","user_id":"' || event_id * 13 % 1000 || '"}' AS attributes FROM events""",
    }
