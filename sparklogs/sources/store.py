"""The log table: Parquet, partitioned by UTC date."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import promoted
from ..schema import LOGS

ROWS_PER_FILE = 5_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows (with dt and id) dealt by day and number. Nearly all rows of a batch are of one day: it is dealt to as many
    tasks as a shuffle has, and the adaptive engine joins small neighbours to files of its advisory size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition("dt", F.pmod(F.xxhash64("id"), F.lit(n)))


def with_promoted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the texts of some attributes as columns of their own."""
    for key in keys:
        if not re.fullmatch(r"\w+", key):
            raise ValueError(f"attribute {key!r} can't name a column")
    return rows.withColumns({promoted(key): F.col("attributes_search")[key] for key in keys})


def promoted_options(keys: Sequence[str]) -> dict[str, str]:
    """Parquet's options for promoted attributes: a bloom filter for each, so that row groups without a value are
    skipped even where its column isn't the one that rows are sorted by."""
    return {f"parquet.bloom.filter.enabled#{promoted(key)}": "true" for key in keys}


def write(rows: DataFrame, path: str, mode: str = "append", promote: Sequence[str] = (), **options: str) -> None:
    """Append rows by date. With promote, the named attributes become columns, and a day's files are sorted by them, so
    that a filter on one reads the row groups and pages that may hold its value only."""
    names = [promoted(key) for key in promote]
    rows = spread(with_promoted(rows.select(*LOGS.fieldNames()), promote))
    if promote:
        rows = rows.sortWithinPartitions("dt", *names, "timestamp")
    writer = rows.write.mode(mode).options(**promoted_options(promote) | options)
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("dt").parquet(path)


def read(spark: SparkSession, path: str, promote: Sequence[str] = ()) -> DataFrame:
    """The table; promote names the attributes that it has as columns."""
    return spark.read.schema(T.StructType([*LOGS.fields, *[T.StructField(promoted(key), T.StringType()) for key in promote]])).parquet(path)


def rows_of(batches: DataFrame) -> DataFrame:
    """Rows of column-oriented batches: parallel arrays ts, lvl, svc, msg and attr per batch_id."""
    row = F.inline(F.arrays_zip("ts", "lvl", "svc", "msg", "attr"))
    out = batches.select("batch_id", row)
    return out.select(
        "batch_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("lvl").alias("level"), F.col("svc").alias("service"),
        F.col("msg").alias("message"), F.col("attr").alias("attributes"),
    )


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def days(spark: SparkSession, path: str) -> list[date]:
    """The dates that have a partition."""
    fs, place = filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(date.fromisoformat(n[3:]) for n in names if n.startswith("dt=") and n[3:] != "__HIVE_DEFAULT_PARTITION__")


def drop_day(spark: SparkSession, path: str, day: date) -> None:
    fs, place = filesystem(spark, f"{path}/dt={day}")
    fs.delete(place, True)


def replace_day(spark: SparkSession, path: str, day: date, rows: DataFrame) -> None:
    """Put rows in the place of a partition: written beside the table, the old partition moved aside, the new one moved
    in, and the old one removed at last. If it stops halfway, the day lies whole in the __staged or the __old folder."""
    top = path.rstrip("/")
    staged, aside = f"{top}__staged/dt={day}", f"{top}__old/dt={day}"
    rows.drop("dt").write.mode("overwrite").parquet(staged)
    fs, target = filesystem(spark, f"{path}/dt={day}")
    old = filesystem(spark, aside)[1]
    fs.delete(old, True)
    fs.mkdirs(old.getParent())
    for a, b in ((target, old), (filesystem(spark, staged)[1], target)):
        if not fs.rename(a, b):
            raise OSError(f"{a} can't be moved to {b}")
    fs.delete(old, True)
