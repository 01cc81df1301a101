"""From request bodies to accepted rows and exact reject reasons."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as attrs
from ..functions import patterns, timestamps
from ..plans.params import LEVELS
from ..sources import workdir

# Limits and the texts of outcomes and reasons.
BODY_LIMIT = 1_048_576
AHEAD = timedelta(minutes=5)
TOO_LARGE = "Request body exceeds the maximum allowed size"
MALFORMED = "Malformed JSON payload"
NO_LOGS = "Invalid request structure: must contain 'logs' array"
EMPTY = "logs array must contain at least one log entry"
NOT_OBJECT = "log entry must be a valid object"
NO_TIMESTAMP = "invalid timestamp: must be a non-empty ISO 8601 string"
BAD_TIMESTAMP = "invalid timestamp format: must be valid ISO 8601"
FUTURE = "timestamp cannot be more than 5 minutes in the future"
BAD_LEVEL = "invalid level: '"
NO_SERVICE = "service must be a non-empty string"
NO_MESSAGE = "message must be a non-empty string"
NOT_FLAT = "attributes must be a flat object"
NESTED = "nested objects or arrays are not allowed in attribute: '"

#: Rows of one range that ids are given in.
RANGE_ROWS = 1_000_000


def envelopes(bodies: DataFrame) -> DataFrame:
    """batch_id, outcome (null: fine) and entries (array of variants) of each body; size, where bodies have it, is told
    without the body."""
    body = F.coalesce("body", F.lit(""))
    size = F.coalesce("size", F.octet_length(body).cast("long")) if "size" in bodies.columns else F.octet_length(body)
    # a parser stops after the first value; in brackets, anything behind it shows as another element or an error
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    shape = body.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$")
    # step by step, so that a body is parsed once; only the beginning of a variant's schema is looked at
    read = bodies.select("batch_id", (size > BODY_LIMIT).alias("large"), F.when(shape, wrapped).alias("wrapped"))
    read = read.select("batch_id", "large", F.when(F.size("wrapped") == 1, F.col("wrapped")[0]).alias("v"))
    read = read.select("batch_id", "large", F.col("v").isNull().alias("broken"), attrs.field(F.col("v"), "logs").alias("logs"))
    # arrays alone can be taken as arrays, and objects alone have fields
    read = read.select("batch_id", "large", "broken", F.try_variant_get("logs", "$", "array<variant>").alias("entries"))
    outcome = F.when(F.col("large"), TOO_LARGE).when(F.col("broken"), MALFORMED).when(F.col("entries").isNull(), NO_LOGS).when(F.size("entries") == 0, EMPTY)
    return read.select("batch_id", outcome.alias("outcome"), F.when(outcome.isNull(), F.col("entries")).alias("entries"))


def exploded(bodies: DataFrame) -> DataFrame:
    """batch_id, index, entry (variant) of the bodies that are fine."""
    return envelopes(bodies).where("outcome IS NULL").select("batch_id", F.posexplode("entries").alias("index", "entry"))


def _level_text(level: Column) -> Column:
    kind = attrs.kind(level)
    item = lambda x: (
        F.when(attrs.kind(x).isin("", "VOID"), "").when(attrs.kind(x).like("OBJECT<%"), "[object Object]").otherwise(attrs.text_of(x))
    )
    return (
        F.when(kind == "", "undefined").when(kind == "VOID", "null").when(kind.like("OBJECT<%"), "[object Object]")
        .when(kind.like("ARRAY<%"), F.array_join(F.transform(F.try_variant_get(level, "$", "array<variant>"), item), ","))
        .otherwise(attrs.text_of(level))
    )


def validated(entries: DataFrame, as_of: datetime) -> DataFrame:
    """entries with reason (null: accepted) and the normalised columns; the first rule that fails gives the reason."""
    names = ("timestamp", "level", "service", "message", "attributes")
    c = F.col
    # step by step, so that each value is taken from the variant and typed once
    rows = entries.select("batch_id", "index", attrs.kind(c("entry")).alias("kind"), *[attrs.field(c("entry"), n).alias(n) for n in names])
    rows = rows.withColumns({f"{n}_kind": attrs.kind(c(n)) for n in names})
    rows = rows.withColumns({f"{n}_text": F.when(c(f"{n}_kind") == "STRING", attrs.text_of(c(n))) for n in names[:4]})
    rows = rows.withColumns(
        {f"{n}_missing": c(f"{n}_text").isNull() | patterns.blank(c(f"{n}_text")) for n in ("timestamp", "service", "message")}
        | {"ts": timestamps.parse_iso(c("timestamp_text")), "given": ~c("attributes_kind").isin("", "VOID")}
        | {"flat": F.try_variant_get(c("attributes"), "$", attrs.MAP)}
    )
    bad = F.map_keys(F.map_filter(c("flat"), lambda _, v: attrs.kind(v).rlike("^(OBJECT|ARRAY)<")))
    rows = rows.withColumn("bad", F.when(c("given"), F.array_min(bad)))
    reason = (
        F.when(~c("kind").like("OBJECT<%"), NOT_OBJECT)
        .when(c("timestamp_missing"), NO_TIMESTAMP)
        .when(c("ts").isNull(), BAD_TIMESTAMP)
        .when(c("ts") > timestamps.literal(as_of + AHEAD), FUTURE)
        .when(c("level_text").isNull() | ~c("level_text").isin(*LEVELS), F.concat(F.lit(BAD_LEVEL), _level_text(c("level")), F.lit("'")))
        .when(c("service_missing"), NO_SERVICE)
        .when(c("message_missing"), NO_MESSAGE)
        .when(c("given") & ~c("attributes_kind").like("OBJECT<%"), NOT_FLAT)
        .when(c("bad").isNotNull(), F.concat(F.lit(NESTED), c("bad"), F.lit("'")))
    )
    return rows.select(
        "batch_id", "index", reason.alias("reason"), c("ts").alias("timestamp"), c("level_text").alias("level"), c("service_text").alias("service"),
        c("message_text").alias("message"), F.when(c("given"), c("flat")).alias("flat"),
    )


def normalised(checked: DataFrame) -> DataFrame:
    """batch_id, index, reason and the stored columns of all entries, those of rejected ones as far as they can be read."""
    return checked.select(
        "batch_id", "index", "reason", "timestamp", "level", "service", "message",
        attrs.canonical(F.col("flat")).alias("attributes"), attrs.search_map(F.col("flat")).alias("attributes_search"), F.to_date("timestamp").alias("dt"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    """batch_id, index and the stored columns of accepted entries."""
    return normalised(checked.where("reason IS NULL")).drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason IS NOT NULL").select("batch_id", F.col("index").cast("int").alias("index"), "reason")


def report(checked: DataFrame) -> DataFrame:
    """batch_id, accepted, rejected [{index, reason}] in order, status (400 if all were rejected). A body is at most 1 MB."""
    bad = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("index").cast("int").alias("index"), "reason")))
    out = checked.groupBy("batch_id").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.sort_array(bad).alias("rejected"))
    return out.withColumn("status", F.when(F.col("accepted") == 0, 400).otherwise(200))


def ranges(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows that are stored, written to path in the order of (batch_id, index): the stored rows with at_ (range and place
    in it), one row per range with the number of rows before it, and the number of rows.

    Spark splits the ranges by a sample of the rows themselves, so neither sparse nor equal batch_ids meet in one; rows
    without a batch_id come last, and rows of equal batch_id and index in the order that they came in.
    """
    spark, count = rows.sparkSession, rows.count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(few, count // 1_000), -(-count // RANGE_ROWS))
    order = [F.col("batch_id").asc_nulls_last(), F.col("index"), F.col("came_")]
    sorted_ = rows.withColumn("came_", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = sorted_.drop("came_").withColumn("at_", F.monotonically_increasing_id())
    out.write.parquet(path)
    stored = spark.read.schema(out.schema).parquet(path)
    stored.written_at = path
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = stored.groupBy(F.shiftright("at_", 33).alias("range_")).agg(F.count("*").alias("n_"))
    return stored, counts.select("range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("offset_")), count


def placed(stored: DataFrame, offsets: DataFrame, base: int = 0) -> DataFrame:
    """What `ranges` stored, with ids base + 1, base + 2, ... in its order."""
    range_, place = F.shiftright("at_", 33), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    out = stored.withColumn("range_", range_).join(F.broadcast(offsets), "range_")
    return out.withColumn("id", (F.lit(base) + F.col("offset_") + place + 1).cast("long")).drop("range_", "offset_", "at_")


def with_ids(rows: DataFrame, base: int = 0) -> DataFrame:
    """rows with ids base + 1, base + 2, ... in the order of (batch_id, index).

    The rows are written once and read back, so that what makes them runs once, and then again in ranges: counts per
    range give its offset, the place inside it the rest. No task holds more than a range.
    """
    path = workdir.fresh(rows.sparkSession, "accepted")
    rows.write.parquet(path)
    stored, offsets, _ = ranges(rows.sparkSession.read.schema(rows.schema).parquet(path), workdir.fresh(rows.sparkSession, "numbered"))
    return placed(stored, offsets, base)
