"""Centroid clustering on integers, each vector finding its centroid by an equal-average equal-variance search.

Vectors become whole numbers, floor(SCALE * x), and centroids are componentwise floors of exact means, so every run and
every partitioning gives the same clusters. A vector's nearest centroid is searched among the centroids sorted by the
sum of their components, outward from its own sum. With n components, sums s and deviations v (root of the summed
squared differences from the mean),

    distance >= (s_x - s_c) ** 2 / n                        ends a direction once it exceeds the best distance so far,
    distance >= (s_x - s_c) ** 2 / n + (v_x - v_c) ** 2     rejects a centroid,

and what is left is compared by whole squared distances (ties: the smaller number). The bounds are doubles with room
for rounding and only ever save work.

A round is one job: each task assigns its vectors and adds them up per cluster, Spark adds up the tasks' sums, and the
driver holds nothing but the sums of k clusters. Vectors are written once and read by every round.

Defined cases: a vector that is null, has another number of components, or holds a null or non-finite component is not
kept and has no row; null ids are hashed as the empty text and count as vectors; repeated ids are rows each, the start
taking equal hashes in the order of their components; fewer kept vectors than k give that many centroids; an empty
table gives no rows; an empty cluster keeps its centroid. Whole numbers are exact whatever their size (beyond 2^27 in
Python's integers, which is slow, and without the bounds); distances and inertias above 2^63 - 1 are given as that. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, WIDTH, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Components up to here have squared distances of WIDTH components within 64 bits.
SAFE = 1 << 27
MOST = (1 << 63) - 1
#: Vectors that one numpy step takes.
STEP = 8_192


def kept(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and x (array<double>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.size("embedding") == width).where(~odd).select("vec_id", x.alias("x"))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where that is safe, else Python integers."""
    # a product by a power of two is exact as long as it is finite
    with np.errstate(over="ignore"):
        q = np.floor(x * float(scale))
    if not x.size or np.abs(q).max() < SAFE:
        return q.astype(np.int64)
    big = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel()]
    return np.array(big, object).reshape(x.shape)


def batches_of(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole_batch in rows:
        for at in range(0, whole_batch.num_rows, STEP):
            batch = whole_batch.slice(at, STEP)
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and deviation of each row; zeros for Python integers, which doubles may not hold."""
    if x.dtype == object or not len(x):
        return np.zeros(len(x)), np.zeros(len(x))
    y = x.astype(np.float64)
    return y.sum(1), np.sqrt(((y - y.mean(1, keepdims=True)) ** 2).sum(1))


@dataclass
class Search:
    """The centroids in the order of their sums. compared counts the distances that were computed."""

    centroids: np.ndarray
    compared: int = field(default=0, init=False)

    def __post_init__(self):
        sums, deviations = _moments(self.centroids)
        self.order = np.argsort(sums, kind="stable")
        self.ordered, self.sums, self.deviations = self.centroids[self.order], sums[self.order], deviations[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of x (whole numbers)."""
        n, width = x.shape
        k = len(self.order)
        kind = object if x.dtype == object or self.centroids.dtype == object else np.int64
        near, best = np.full(n, -1, np.int64), np.full(n, MOST, kind)
        bound = np.full(n, np.inf)  # best as a double, with room for rounding
        bounded = kind is not object  # Python integers may be too large for the bounds: all centroids are compared
        sums, deviations = _moments(x)
        # outward from the own sum: the next centroid below and the next above
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        alive = np.arange(n)
        while len(alive):
            below = np.where(left[alive] >= 0, (sums[alive] - self.sums[left[alive]]) ** 2 / width, np.inf)
            above = np.where(right[alive] < k, (sums[alive] - self.sums[np.minimum(right[alive], k - 1)]) ** 2 / width, np.inf)
            down = (below <= above) & (left[alive] >= 0)
            gap = np.where(down, below, above)
            more = down | (right[alive] < k)
            go = more & (gap <= bound[alive]) if bounded else more  # all that lie further out are further off too
            alive, down, gap = alive[go], down[go], gap[go]
            at = np.where(down, left[alive], right[alive])
            left[alive[down]] -= 1
            right[alive[~down]] += 1
            ok = gap + (deviations[alive] - self.deviations[at]) ** 2 <= bound[alive] if bounded else np.ones(len(alive), bool)
            rows, at = alive[ok], at[ok]
            if not len(rows):
                continue
            self.compared += len(rows)
            d = x[rows].astype(kind) - self.ordered[at].astype(kind)
            d = (d * d).sum(1)
            number = self.order[at]
            better = (near[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (number < near[rows]))
            rows, d, number = rows[better], d[better], number[better]
            near[rows], best[rows] = number, d
            if bounded:
                bound[rows] = d.astype(np.float64) * (1 + 1e-9) + 1.0
        return near, best


def _table(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= SAFE for c in centroids for v in c)
    return np.array(centroids, object if big else np.int64).reshape(len(centroids), -1)


def _parts(v: int) -> list[int]:
    """v in parts of 18 digits, the low ones first, all of v's sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while not out or v:
        v, low = divmod(v, 10**18)
        out.append(sign * low)
    return out


def start(points: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the least hash of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in whole(np.array(r.x, np.float64))] for r in first]


def step(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    width = len(centroids[0])

    def run(batches):
        search = Search(_table(centroids))
        sums = [[0] * width for _ in centroids]
        counts = [0] * len(centroids)
        for _, x in batches_of(batches, width):
            x = whole(x)
            near, _ = search.nearest(x)
            for c in np.unique(near):
                mine = x[near == c]
                counts[c] += len(mine)
                sums[c] = [a + int(b) for a, b in zip(sums[c], mine.sum(0), strict=True)]
        # a sum of any size in parts of 18 digits, which Spark adds up; the first part carries the number of vectors
        rows = [(c, j, i, counts[c] if i == 0 else 0, part) for c in range(len(centroids)) if counts[c] for j in range(width) for i, part in enumerate(_parts(sums[c][j]))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], ["c", "j", "i", "n", "part"])

    parts = points.select("x").mapInArrow(run, "c int, j int, i int, n long, part long")
    total = parts.groupBy("c", "j", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int], int] = {}
    for r in total.collect():  # k times the width
        counts[r.c, r.j] = counts.get((r.c, r.j), 0) + r.n
        sums[r.c, r.j] = sums.get((r.c, r.j), 0) + int(r.part) * 10 ** (18 * r.i)
    out = [list(c) for c in centroids]
    for (c, j), n in counts.items():
        out[c][j] = sums[c, j] // n
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of the kept vectors, and the final centroids."""
    points = materialize(kept(vectors, width), "points")
    centroids = start(points, k, seed)
    if not centroids:  # no vectors
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        after = step(points, centroids)
        if after == centroids:  # a fixed point: further rounds change nothing
            break
        centroids = after
    final = centroids

    def run(batches):
        search = Search(_table(final))
        for batch, x in batches_of(batches, width):
            near, best = search.nearest(whole(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array([min(int(v), MOST) for v in best], pa.int64())], ["vec_id", "cluster", "distance"])

    kind = dict(points.dtypes)["vec_id"]
    return materialize(points.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "assigned"), centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    assigned, centroids = cluster(vectors, k, rounds, seed, width)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    by = {r.cluster: int(r.d) for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def per(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1) if values else F.lit(None)

    cut = lambda v: min(v, MOST)
    return assigned.select(
        "vec_id", "cluster", "distance", per([cut(by.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(cut(sum(by.values()))).cast("long").alias("inertia"), per(digests).cast("string").alias("centroid_sha256"),
    )
