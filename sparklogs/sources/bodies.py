"""Request bodies from text files: a body per file, or a body per line.

Files are listed with their sizes first, and a file above the limit is reported without being read. The batch id is the
file's path, and with lines the number of the line behind it. Spark lists no empty files: they give no row.

A file of lines is one task's work, so it has a limit of its own (LINES_LIMIT); larger ones are to be split by their
writer. Text that isn't UTF-8 is read with replacement characters, which JSON then refuses or keeps inside of strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY_LIMIT = 1_048_576
LINES_LIMIT = 256 << 20


def _listed(spark: SparkSession, path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(path, content, length) of files up to the limit, and (path, length) of larger ones, whose content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= limit), files.where(F.col("length") > limit).select("path", "length")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, body, size of a folder whose files are one body each; the body of a file above the limit is null."""
    small, large = _listed(spark, path, BODY_LIMIT)
    small = small.select(F.col("path").alias("batch_id"), F.expr("CAST(content AS STRING)").alias("body"), F.col("length").alias("size"))
    return small.union(large.select("path", F.lit(None).cast("string"), "length"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """batch_id (path#line), body, size of a folder of files with a body in each line; empty lines are none. A file
    above LINES_LIMIT is one row without a body."""
    small, large = _listed(spark, path, LINES_LIMIT)
    rows = small.select("path", F.posexplode(F.split(F.expr("CAST(content AS STRING)"), "\r?\n")).alias("line", "body")).where("body <> ''")
    rows = rows.select(F.concat_ws("#", "path", (F.col("line") + 1).cast("string")).alias("batch_id"), "body", F.octet_length("body").cast("long").alias("size"))
    return rows.union(large.select("path", F.lit(None).cast("string"), "length"))
