"""Sharding by a k-d tree: nodes are split at weighted medians along their widest dimension until leaves reach a size.

Each document is a point with metadata coordinates and a weight (its bytes). A node that is to become k leaves of the
target bytes is split where k // 2 shares of its weight lie below; the cut is found by histograms of the node's keys,
each round narrowing the interval that holds it, so that a level costs a few aggregations of at most `BINS` rows per
node and no sort. Keys order points by the coordinate, then by the text's hash: equal texts are neighbours and stay
together, but a group of copies that would make a half miss its share by more than 2 x SLACK of the node is cut, by a
hash of the document.

The driver holds one entry per node of a level: meant for up to some thousand leaves.

Defined cases: a null text weighs 1 byte and has crc32 0; null ids are ordinary rows; repeated rows are documents
each; leaves may be empty where there are fewer documents than leaves; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

BINS = 512
DIMS = 3
#: The share of a node's weight by which a half may miss the middle so that equal texts stay together.
SLACK = 0.004
SLOT_ROWS = 20_000
_HALF = 1 << 31


def _coordinate(share):
    return F.least(F.lit(_HALF - 1), F.floor(share * _HALF)).cast("long")


def _by_node(values: dict[int, int]):
    """The value of a row's node, null if it has none."""
    if not values:
        return F.lit(None).cast("long")
    return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v).cast("long"))])[F.col("node")]


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the coordinates c0.. (31 bits each) and the tie-breaks h (text) and g (document)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    h = F.xxhash64(F.col("text"), F.lit("text"))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        # metadata of the text: its length, bytes per character (the alphabet) and bytes per line
        _coordinate(F.log2(F.octet_length(raw) + 1) / 32).alias("c0"),
        _coordinate(F.octet_length(raw) / (F.coalesce(F.length("text"), F.lit(0)) + 1) / 5).alias("c1"),
        _coordinate(F.log2(F.octet_length(raw) / (F.octet_length(raw) - F.octet_length(F.translate(raw.cast("string"), "\n", "")) + 1) + 1) / 32).alias("c2"),
        F.shiftrightunsigned(h, 33).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("document")), 1).alias("g"),
    )


def _median(rows: DataFrame, key, nodes: dict[int, tuple[int, int, int, int]]) -> dict[int, tuple[int, int]]:
    """For each node the cut c of its keys (key < c goes left) and the weight left of it.

    nodes: node -> lo, hi (keys), weight below lo, weight aimed at. Rounds of histograms narrow lo..hi until the cut
    that lies nearest to the aim is found or the aim is met within SLACK of what lies in the first interval.
    """
    found: dict[int, tuple[int, int]] = {}
    slack = {n: max(1, int(SLACK * 2 * aim)) for n, (_, _, _, aim) in nodes.items()}
    while nodes:
        lo, hi = (_by_node({n: v[i] for n, v in nodes.items()}) for i in (0, 1))
        step = _by_node({n: max(1, -(-(v[1] - v[0] + 1) // BINS)) for n, v in nodes.items()})
        inside = rows.where(F.col("node").isin(list(nodes))).withColumn("key", key)
        inside = inside.where((F.col("key") >= lo) & (F.col("key") <= hi)).withColumn("lo", lo).withColumn("step", step)
        bins = inside.withColumn("bin", F.expr("(key - lo) div step")).groupBy("node", "bin").agg(
            F.sum("size").alias("w"), F.min("key").alias("least"), F.max("key").alias("most")
        ).collect()  # at most BINS rows per node
        after = {}
        for n, (_, _, below, aim) in nodes.items():
            own = sorted((b for b in bins if b["node"] == n), key=lambda b: b["bin"])
            for b in own:
                if below + b["w"] >= aim or b is own[-1]:
                    break
                below += b["w"]
            left, right = aim - below, below + b["w"] - aim
            if min(left, abs(right)) <= slack[n] or b["least"] == b["most"]:
                found[n] = (b["least"], below) if left <= abs(right) else (b["most"] + 1, below + b["w"])
            else:
                after[n] = (b["least"], b["most"], below, aim)
        nodes = after
    return found


def _split(rows: DataFrame, leaves: dict[int, int], base: list[float]) -> tuple[DataFrame, dict[int, int], list[float]]:
    """Every node of several leaves in two, along the dimension that is widest in it, measured by its spread over the
    whole table. A node is known by its first leaf."""
    open_ = {n: k for n, k in leaves.items() if k > 1}
    stats = rows.where(F.col("node").isin(list(open_))).groupBy("node").agg(
        F.sum("size").alias("w"), *[F.round(F.stddev_pop(F.col(f"c{d}") / _HALF), 9).alias(f"sd{d}") for d in range(DIMS)]
    ).collect()  # one row per node
    base = base or [stats[0][f"sd{d}"] or 1.0 for d in range(DIMS)]
    wide = {s["node"]: max(range(DIMS), key=lambda d: (round((s[f"sd{d}"] or 0.0) / base[d], 6), -d)) for s in stats}
    key = F.shiftleft(F.get(F.array(*[f"c{d}" for d in range(DIMS)]), _by_node(wide).cast("int")), 31) + F.col("h")
    weight = {s["node"]: s["w"] for s in stats}
    aim = {n: -(-w * (open_[n] // 2) // open_[n]) for n, w in weight.items()}
    cuts = _median(rows, key, {n: (0, (1 << 62) - 1, 0, a) for n, a in aim.items()})
    # a cut that is still too far from its aim lies at one text's copies: those are dealt by document
    heavy = {n: c for n, c in cuts.items() if abs(c[1] - aim[n]) > 2 * SLACK * weight[n]}
    groups, inner = {}, {}
    if heavy:
        low = _by_node({n: c for n, (c, _) in heavy.items()})
        near = rows.where(F.col("node").isin(list(heavy))).withColumn("key", key)
        sides = near.groupBy("node").agg(F.max(F.when(F.col("key") < low, F.col("key"))).alias("l"), F.min(F.when(F.col("key") >= low, F.col("key"))).alias("r")).collect()
        for s in sides:
            _, below = heavy[s["node"]]
            groups[s["node"]] = s["l"] if below > aim[s["node"]] else s["r"]
        groups = {n: k for n, k in groups.items() if k is not None}
    if groups:
        near = rows.where(F.col("node").isin(list(groups))).withColumn("key", key)
        below = {r["node"]: r["w"] for r in near.where(F.col("key") < _by_node(groups)).groupBy("node").agg(F.sum("size").alias("w")).collect()}
        found = _median(rows.where(key == _by_node(groups)), F.col("g"), {n: (0, (1 << 63) - 1, below.get(n, 0), aim[n]) for n in groups})
        inner = {n: min(c, (1 << 63) - 1) for n, (c, _) in found.items()}
    one = _by_node(groups)
    right = F.when(one.isNotNull(), (key > one) | (key == one) & (F.col("g") >= _by_node(inner))).otherwise(key >= _by_node({n: c for n, (c, _) in cuts.items()}))
    after = {n: k for n, k in leaves.items() if k == 1}
    after |= {n: k // 2 for n, k in open_.items()} | {n + k // 2: k - k // 2 for n, k in open_.items()}
    step = _by_node({n: k // 2 for n, k in open_.items()})
    moved = F.when(right, F.col("node") + step).otherwise(F.col("node")).cast("int")
    return rows.withColumn("node", moved), after, base


def shard(docs: DataFrame, target_bytes: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard); shards are as many as the table has
    times target_bytes, and of equal size but for SLACK and the sizes of single documents."""
    rows = materialize(points(docs).withColumn("node", F.lit(0)), "points")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves, base = {0: max(1, -(-total // target_bytes))}, []
    while any(k > 1 for k in leaves.values()):
        split, leaves, base = _split(rows, leaves, base)
        after = materialize(split, "nodes")
        release(rows)
        rows = after
    return numbered(rows.withColumnRenamed("node", "shard"))


def total_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0


def numbered(rows: DataFrame) -> DataFrame:
    """Slots by bucket counts and a row number within each bucket; a bucket holds about SLOT_ROWS rows."""
    rows = materialize(rows.select("doc_id", "size", "text_crc32", "shard", "g"), "shards")
    n = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("g", "doc_id", "text_crc32")
    ranked = rows.withColumn("inner", F.row_number().over(inside))
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inner") - 1).cast("long").alias("slot")
    )
