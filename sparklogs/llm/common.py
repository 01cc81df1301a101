"""Pieces that the operators share: reading, cutting lineage, words as numpy arrays, grouped scans."""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step takes; the arrays over it are some dozen times as large.
STEP_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_counter = itertools.count()
_own_dir: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/sparklogs-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Spark removes the shuffle files of the write at its end, so the disk holds those of one step at a time.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{next(_counter)}-{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote and that nothing reads any more."""
    for table in tables:
        place = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
        place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id="doc_id"):
    """The rows that no label is learned from: crc32 of the id as text, mod 4, is 2 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# --- words ---------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * STEP_BYTES)
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t))
        _powers[:] = tables if n <= 4 * STEP_BYTES else []
        return tables[0], tables[1]
    return _powers[0], _powers[1]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("") if not pa.types.is_binary(column.type) else column.fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of consecutive rows: byte starts and ends, 64-bit hashes, and first[i]:first[i+1] for row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        before = np.empty(len(data), bool)
        before[1:] = solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[:1] = False
        before[edges] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.empty(len(data), bool)
        after[:-1] = solid[1:]
        after[-1:] = False
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            power, inverse = _power_tables(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run past their row mean nothing (see gram_ok)."""
        return gram_hashes(self.hashes, k)

    def gram_ok(self, k: int) -> np.ndarray:
        return np.arange(len(self.starts)) + k <= np.repeat(self.first[1:], self.counts())


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        out[: len(words) - j] = out[: len(words) - j] * _GRAM + words[j:]
    return mix(out)


# --- scans over sorted groups --------------------------------------------------------------------------------


def over_groups(df: DataFrame, key: str, step: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 50_000) -> DataFrame:
    """Sort each partition of df by `key` and hand `step` tables of whole groups, many groups at a time.

    df must be partitioned so that the rows of a key are together and a group is bounded. A table holds about
    `rows` rows, or one group if that is larger.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
            if cut:
                if (out := step(table.slice(0, cut).combine_chunks())) is not None:
                    yield out
                table = table.slice(cut)
            held, n = table.combine_chunks().to_batches(), table.num_rows
        if held and (out := step(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return df.sortWithinPartitions(key).mapInArrow(run, schema)


def local_roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n members the least one that the links p[i] - q[i] reach."""
    root = np.arange(n)
    while True:
        after = root.copy()
        np.minimum.at(after, p, root[q])
        np.minimum.at(after, q, root[p])
        after = after[after]
        if (after == root).all():
            return root
        root = after


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star steps, each a partial-aggregated minimum and a join that the adaptive
    engine can split; lineage is cut after every round, until no edge changes. Nodes are longs without null.
    """
    edges = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    while True:
        both = edges.union(edges.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m")).distinct()
        after = materialize(small, "edges")
        release(edges)
        edges = after
        n, stars = edges.agg(F.count("*"), F.count_distinct("a")).first()
        roots = edges.select(F.col("b").alias("a")).distinct()
        if n == stars and edges.join(roots, "a", "left_semi").limit(1).count() == 0:
            return edges.selectExpr("a AS node", "b AS root").union(edges.selectExpr("b", "b").distinct())
