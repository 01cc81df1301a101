"""Fixed schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attributes_search", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dt", T.DateType()),
    ]
)
REJECTS = T.StructType(
    [T.StructField("batch_id", T.LongType()), T.StructField("index", T.IntegerType()), T.StructField("reason", T.StringType())]
)
ROLLUP = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
