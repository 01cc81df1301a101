"""Logs and raw request bodies from an events table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as attrs
from ..functions import timestamps

PER_BATCH = 50


def logs(events: DataFrame, *more: str) -> DataFrame:
    """The logs view of the events: id, timestamp, level, service, message, attributes, attributes_search, dt, and columns of theirs."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "view", "debug")
    service = F.array(*map(F.lit, ("checkout", "auth", "payment", "inventory")))[F.pmod("user_id", F.lit(4)).cast("int")]
    ts = F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").alias("id"), ts.alias("timestamp"), level.otherwise("info").alias("level"), service.alias("service"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"), F.col("props").alias("attributes"),
        F.transform_values(attrs.parsed(F.col("props")), lambda _, v: attrs.text_of(v)).alias("attributes_search"), F.to_date(ts).alias("dt"), *more,
    )


def bodies(events: DataFrame, as_of: datetime) -> DataFrame:
    """batch_id and body: requests of 50 entries, with faults planted by the event's number, each in several forms."""
    i = F.col("id")

    def form(every: int, *texts: str | None) -> Column:
        """One of the texts for the ids that `every` divides, in turns; None leaves the field out."""
        turn = F.floor(i / every) % len(texts)
        out = F.when(turn == 0, F.lit(texts[0]).cast("string"))
        for k, text in enumerate(texts[1:], 1):
            out = out.when(turn == k, F.lit(text).cast("string"))
        return out

    rows = logs(events, "ts").select("id", "timestamp", "level", "service", "message", "attributes", "ts")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    late = as_of + timedelta(minutes=10)
    micros = F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    inner = F.regexp_extract("attributes", r"^\{(.*)\}$", 1)
    ts = (
        F.when(i % 83 == 0, form(83, "not-a-date", "2024-13-05T10:00:00Z", "10:15", "2024/01/05")).when(i % 79 == 0, timestamps.iso(timestamps.literal(late)))
        .when(i % 43 == 0, micros).otherwise(timestamps.iso(F.col("timestamp")))
    )
    parts = [
        F.when(i % 89 == 0, form(89, None, '"timestamp":"  "', '"timestamp":null', '"timestamp":1704067200')).otherwise(F.concat(F.lit('"timestamp":'), quoted(ts))),
        F.when(i % 73 == 0, form(73, '"level":"critical"', '"level":"ERROR"', '"level":7', None)).otherwise(F.concat(F.lit('"level":'), quoted(F.col("level")))),
        F.when(i % 71 == 0, form(71, '"service":"   "', '"service":""', '"service":null', '"service":5')).otherwise(F.concat(F.lit('"service":'), quoted(F.col("service")))),
        F.when(i % 67 == 0, form(67, '"message":""', '"message":"\\t\\n "', None, '"message":{"a":1}')).otherwise(F.concat(F.lit('"message":'), quoted(F.col("message")))),
        F.when(i % 61 == 0, form(61, '"attributes":[1]', '"attributes":"x"', '"attributes":5', '"attributes":true'))
        .when(i % 59 == 0, form(59, '"attributes":{"tags":["a"]}', '"attributes":{"a":1,"tags":{"b":2}}'))
        .when(i % 53 == 0, F.concat(F.lit('"attributes":{'), inner, F.lit(',"gone":null}')))
        .when(i % 47 != 0, F.concat(F.lit('"attributes":'), F.col("attributes"))),
    ]
    entry = F.when(i % 97 == 0, form(97, '"just text"', "null", "[1,2]", "17")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    placed = rows.select(F.floor(i / PER_BATCH).cast("long").alias("batch_id"), F.struct((i % PER_BATCH).alias("at"), entry.alias("entry")).alias("e"))
    grouped = placed.groupBy("batch_id").agg(F.sort_array(F.collect_list("e"))["entry"].alias("entries"))  # 50 entries
    b = F.col("batch_id")
    body = (
        F.when(b % 31 == 0, F.lit('{"logs": [')).when(b % 29 == 0, F.lit('{"entries": []}')).when(b % 23 == 0, F.lit('{"logs": []}'))
        .otherwise(F.concat(F.lit('{"logs":['), F.concat_ws(",", "entries"), F.lit("]}")))
    )
    # as from many files: few rows, but large ones
    return grouped.select("batch_id", body.alias("body")).repartition(events.sparkSession.sparkContext.defaultParallelism)
