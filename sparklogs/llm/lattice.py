"""Embedding near-duplicates by lattice hashing.

Each table projects a vector to eight dimensions, once or several times, with fixed random matrices and decodes the
points to the E8 lattice; the lattice points, with the label, are the vector's cell. A vector is kept in its own cell
and probes the neighbouring cell whose lattice point comes next. Vectors that meet in a cell are compared by exact
cosine in double precision.

Cells must become smaller as vectors become more, or strangers meet. `plan` simulates how often pairs at the threshold
meet in one table for each of some cell sizes and numbers of lattice points, takes as many tables as lift that to
RECALL, and chooses what moves the fewest bytes for this number of vectors: ids are dealt to cells first, and only
vectors that have company in a cell are sent there.

A pair may meet in several tables: it counts in the first table where it meets, which both vectors' cells tell, so
no list of pairs is made or shuffled. Equal vectors are compared once and carry their number. A cell with many
vectors is dealt in blocks of BLOCK to many tasks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing and are kept; rows of other lengths than the first usual one meet only their like; repeated rows
(equal vec_id) are vectors each, linked by their id; vectors without an id link others like any, and have the least id
that links reach (null if none has one); an empty table gives no rows; other columns are ignored.

"Met in an earlier table" is told by 32 bits of the cells' names, so a pair may count nowhere with a probability of some
3 x tables / 2^32: about one link in 10^8 with 14 tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, materialize, mix, over_groups, release

BLOCK, SEED = 2_048, 8
LEAST = 0.93
#: The share of the pairs at the threshold that the tables must bring together, in the plan's simulation.
RECALL = 0.99
#: (lattice points a cell, width of a lattice step) that a plan chooses from.
SIZES = ((1, 1.5), (1, 1.25), (1, 1.0), (2, 2.0), (2, 1.5), (2, 1.25), (3, 2.0), (3, 1.5), (4, 2.0), (4, 1.5))
#: For the plan: bytes of an entry of a cell, of a vector that is sent to one, those that cost as much as comparing a
#: pair, and the share of vectors that have near copies.
ENTRY_BYTES, VECTOR_BYTES, PAIR_BYTES, COPIES = 20, 600, 20, 0.2


@dataclass(frozen=True)
class Plan:
    points: int
    step: float
    tables: int


def projections(width: int, plan: Plan, seed: int = SEED) -> np.ndarray:
    """planes[table, point, width, 8]."""
    return np.random.default_rng([seed, width]).normal(0, 1 / plan.step, (plan.tables, plan.points, width, 8))


def plan(vectors: int, width: int = 64, least: float = LEAST) -> Plan:
    """The cheapest plan for `vectors` vectors that may be compared with each other."""
    rng = np.random.default_rng(SEED)
    x, y = rng.normal(size=(2, 600, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = least * x + math.sqrt(1 - least**2) * y / np.linalg.norm(y, axis=1)[:, None]
    best = None
    for points, step in SIZES:
        planes = projections(width, Plan(points, step, 3))
        a, b = cells(x, planes), cells(y, planes)
        met = float(((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(2).mean())
        if met < 0.01:
            continue  # too few pairs to tell
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - met)) if met < 1 else 1
        # two unrelated unit vectors share a lattice point with probability (step / sqrt(4 pi)) ** 8
        strangers = 2 * vectors * min(1.0, step / math.sqrt(4 * math.pi)) ** (8 * points)
        sent = COPIES + (1 - COPIES) * -math.expm1(-strangers)
        cost = 2 * tables * (ENTRY_BYTES + sent * VECTOR_BYTES)
        # vectors are compared with the strangers that they meet
        cost += 2 * tables * strangers * PAIR_BYTES
        if best is None or cost < best[0]:
            best = cost, Plan(points, step, tables)
    return best[1]


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest point of D8: integers whose sum is even."""
    r = np.rint(y)
    odd = r.sum(1).astype(np.int64) % 2 != 0
    gap = y - r
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
    return r


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 shifted by a half: doubled, so that it is whole."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(near[:, None], 2 * a, 2 * b).astype(np.int64)


#: The 240 shortest vectors of E8 (doubled): by the rule that they are +-1 in two places, or halves with even minus signs.
def _shortest() -> np.ndarray:
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for s in (-2, 2):
                for t in (-2, 2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        if bin(m).count("1") % 2 == 0:
            out.append(np.array([-1 if m >> k & 1 else 1 for k in range(8)]))
    return np.stack(out)


SHORTEST = _shortest()


def _name(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        h = mix(h * np.uint64(1_099_511_628_211) + points[..., k].astype(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """names[row, table, 0..1]: the own cell of unit vectors x, and the neighbour with the next lattice point."""
    out = np.empty((len(x), len(planes), 2), np.int64)
    rows = np.arange(len(x))
    for t, points in enumerate(planes):
        names, gains, others = [], [], []
        for k, plane in enumerate(points):
            y = x @ plane
            own = nearest(y)
            # |y - (p + v)| is least where v . (y - p) is largest, all v being equally long
            gain = (y - own / 2) @ SHORTEST.T
            best = gain.argmax(1)
            gains.append(gain[rows, best])
            names.append(mix(_name(own).view(np.uint64) + np.uint64(k)))
            others.append(mix(_name(own + SHORTEST[best]).view(np.uint64) + np.uint64(k)))
        total, which = np.sum(names, axis=0, dtype=np.uint64), np.argmax(gains, axis=0)
        out[:, t, 0] = total.view(np.int64)
        out[:, t, 1] = (total - np.array(names)[which, rows] + np.array(others)[which, rows]).view(np.int64)
    return out


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = [np.asarray(v, np.float64) if v is not None and len(v) and None not in v else None for v in batch.column("embedding").to_pylist()]
    good = [i for i, v in enumerate(rows) if v is not None and np.isfinite(v).all() and v.any()]
    out = []
    for i in good:
        out.append(_units(rows[i][None])[0])
    return np.array(good, np.int64), out


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1)[:, None]  # no overflow
    return v / np.sqrt((v * v).sum(1))[:, None]


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positions of links that connect as much as all of them."""
    _, star = np.unique(p, return_index=True)  # a link of each p, and below a link between any two p that share a q
    _, back = np.unique(q, return_index=True)
    root = local_roots(n, np.concatenate((p[star], p[back])), np.concatenate((q[star], q[back])))
    return np.unique(np.concatenate((star, back, np.flatnonzero(root[p] != root[q]))))


def links(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    raw = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", raw.alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("group", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.md5(F.concat(F.col("label"), F.lit("|"), F.to_json("embedding")))))
    good = F.exists("embedding", lambda v: v != 0) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("group").isNotNull() & F.coalesce(good, F.lit(False))
    ids = materialize(rows.select("vec_id", "group", F.when(good, F.xxhash64("group")).alias("key")), "vectors")
    # one row for equal vectors of a label, with their number and least id
    one = rows.where("group IS NOT NULL").groupBy("group", "label").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id"))
    one = materialize(one.withColumn("key", F.xxhash64("group")), "distinct")

    most = one.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width = one.where("embedding IS NOT NULL").agg(F.max(F.size("embedding"))).first()[0] or 1
    chosen = plan(most, max(2, width), least)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # then single precision holds the components exactly

    def hashed(batches):
        for batch in batches:
            good, units = _unit(batch)
            label = batch.column("label").to_pylist()
            salt = np.array([hash_text(label[i]) for i in good], np.int64)
            by_width: dict[int, list[int]] = {}
            for k, u in enumerate(units):
                by_width.setdefault(len(u), []).append(k)
            for width, at in by_width.items():
                x = np.stack([units[k] for k in at])
                names = cells(x, projections(width, chosen)) ^ salt[at][:, None, None] ^ np.int64(width)
                rows = pa.array(good[at])
                size = names.shape[1] * names.shape[2]
                cuts = pa.array(range(0, (len(at) + 1) * size, size), pa.int32())
                # what tells where two vectors meet: own cells and probed ones, of every table
                names_ = pa.ListArray.from_arrays(cuts, pa.array(names.reshape(-1)))
                short = pa.ListArray.from_arrays(cuts, pa.array((names.reshape(-1) >> 32).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("key", "n", "embedding")), names_, short], ["key", "n", "x", "names", "short"])

    kind = "float" if single else "double"
    schema = f"key long, n long, x array<{kind}>, names array<long>, short array<int>"
    points = materialize(one.select("key", "n", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).mapInArrow(hashed, schema), "points")
    # one entry for each table and cell that a vector is in or probes
    entries = points.select("key", F.posexplode("names").alias("slot", "cell")).select(
        "key", F.expr("CAST(slot DIV 2 AS INT)").alias("table"), F.expr("slot % 2 > 0").alias("probe"), "cell"
    )
    sizes = entries.groupBy("table", "cell").agg(F.count("*").alias("size"), F.count_if(~F.col("probe")).alias("own"))
    sizes = materialize(sizes.where("size > 1 AND own > 0").withColumn("blocks", F.expr(f"CAST(ceil(size / {BLOCK}) AS INT)")), "cells")
    met = entries.join(sizes, ["table", "cell"])
    # every pair of blocks of a cell meets once: block i goes to (i, j) for j >= i and to (j, i) for j < i
    mine = F.pmod(F.xxhash64("key", "table"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "table", "probe", F.xxhash64("table", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("meet"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") == F.col("other")).alias("same"))
    met = met.join(points.select("key", "n", "x", F.col("short").alias("names")), "key")

    def compare(table: pa.Table) -> pa.RecordBatch:
        meet = table.column("meet").to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], meet[1:] != meet[:-1])))
        ends = np.concatenate((heads[1:], [len(meet)]))
        keys, count, tables = (table.column(c).to_numpy() for c in ("key", "n", "table"))
        probe, left, same = (table.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "left", "same"))
        x, names = (table.column(c).combine_chunks() for c in ("x", "names"))
        x_at, n_at = (c.offsets.to_numpy() for c in (x, names))
        x_all, n_all = x.values.to_numpy(), names.values.to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(heads, ends, strict=True):
            if b - a < 2:
                continue
            width = x_at[a + 1] - x_at[a]
            v = _units(x_all[x_at[a] : x_at[b]].reshape(b - a, width).astype(np.float64))
            c = n_all[n_at[a] : n_at[b]].reshape(b - a, -1, 2)
            i, j = (np.arange(b - a),) * 2 if same[a] else (np.flatnonzero(left[a:b]), np.flatnonzero(~left[a:b]))
            if not len(i) or not len(j):
                continue
            t, near, pairs = tables[a], np.zeros(b - a, np.int64), []
            for rows in np.array_split(i, -(-len(i) // 256)):  # a tile of the products at a time
                cos = v[rows] @ v[j].T
                ok = (cos >= least) & (keys[a:b][rows][:, None] != keys[a:b][j][None, :])
                ok &= ~(probe[a:b][rows][:, None] & probe[a:b][j][None, :])  # one of the two is at home
                p, q = np.nonzero(ok)
                p, q = rows[p], j[q]
                # met before: in an earlier table one's home is among the other's cells; in this one, home meets home once
                for e in range(t):
                    if not len(p):
                        break
                    own_p, own_q = c[p, e, 0], c[q, e, 0]
                    apart = (own_p != own_q) & (own_p != c[q, e, 1]) & (own_q != c[p, e, 1])
                    p, q = p[apart], q[apart]
                if not len(p):
                    continue
                # in this table a pair can meet at both homes: it counts at the smaller cell of the places where it meets
                own_p, own_q = c[p, t, 0], c[q, t, 0]
                p_there, q_there = (c[p, t] == own_q[:, None]).any(1), (c[q, t] == own_p[:, None]).any(1)
                first = np.where(p_there & q_there, np.minimum(own_p, own_q), np.where(q_there, own_p, own_q))
                keep = first == np.where(probe[a:b][p], own_q, own_p)
                p, q = p[keep], q[keep]
                near += np.bincount(p, count[a:b][q], b - a).astype(np.int64)
                if not same[a]:
                    near += np.bincount(q, count[a:b][p], b - a).astype(np.int64)
                # each row's least partner and the least of all its rows keep the links of a tile
                pairs.append(np.stack([p, q])[:, _forest(b - a, p, q)])
            if not pairs:
                continue
            p, q = np.concatenate(pairs, axis=1)
            root = local_roots(b - a, p, q)
            hit = np.flatnonzero((near > 0) | (root != np.arange(b - a)))
            found.append((keys[a:b][hit], near[hit], keys[a:b][root[hit]]))
        if not found:
            found = [(np.zeros(0, np.int64),) * 3]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], ["key", "near", "root"])

    met = met.repartition("meet")
    near = materialize(over_groups(met, "meet", compare, "key long, near long, root long", 8_000), "near")
    release(points, sizes)
    counts = near.groupBy("key").agg(F.sum("near").alias("near"))
    # nodes are vectors, whether they have an id or not; the vectors of one id are linked by it
    named = ids.where("vec_id IS NOT NULL AND key IS NOT NULL")
    same = named.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
    same = named.join(same, "vec_id").where("key <> a").select("key", F.col("a").alias("root"))
    edges = near.where("key <> root").select("key", "root").union(same)
    roots = components(edges.select(F.col("key").alias("a"), F.col("root").alias("b")))
    members = roots.join(one.select("key", "vec_id"), F.col("node") == F.col("key")).select("key", "root", "vec_id")
    least_id = members.groupBy("root").agg(F.min("vec_id").alias("component"))
    roots = members.join(least_id, "root").select(F.col("key").alias("node"), "component")
    known = one.select("key", "n", "vec_id").join(counts, "key", "left").join(roots, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias("key_"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "vec_id").alias("root")
    )
    out = ids.join(known, F.col("key") == F.col("key_"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def hash_text(text: str) -> np.int64:
    h = np.zeros(1, np.uint64)
    for c in text.encode():
        h = mix(h * np.uint64(1_099_511_628_211) + np.uint64(c + 1))
    return h.view(np.int64)[0]
