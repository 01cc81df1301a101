import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparklogs.llm import mixing, sharding


def filled(sizes, share=1.5, most=2):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_prefix_sums(spark, docs):
    texts = [(i, "w " * (i % 7 * 3)) for i in range(300)]
    frame = docs(*texts[:200], source="b").unionByName(docs(*texts[200:240], source="a")).unionByName(docs(*texts[240:], source=None))
    frame = frame.unionByName(docs((900, None), (901, ""), (None, "x y"), (5, texts[5][1]), source="b"))
    rows = mixing.plan(frame).collect()
    assert len(rows) == 304
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by = {r.doc_id: r.source for r in frame.select("doc_id", "source").collect()}
    for r in rows:
        s = by[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == int(target[s] + 1e-9)
    assert sorted(map(tuple, mixing.plan(frame.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_takes_effect(docs):
    frame = docs(*["word " * 10] * 40, source="a").unionByName(docs(*[(100 + i, "word " * 10) for i in range(40)], source="b"))
    from pyspark.sql import functions as F

    frame = frame.withColumns({n: F.lit("x") for n in ("id_", "taken_", "size_", "epoch_", "row", "left_", "rank_", "digest", "hash")})
    out = mixing.apply(frame)
    assert out.columns == frame.columns
    words = {r.source: r["count"] * 10 for r in out.groupBy("source").count().collect()}
    assert words == {"a": 800, "b": 400}
    assert mixing.plan(frame.limit(0)).count() == 0 and mixing.apply(frame.limit(0)).count() == 0


def test_rows_without_id_keep_their_sources_cut(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    frame = docs(*[(None, f"t{i} " * 10) for i in range(60)], source="a").unionByName(docs(*[(None, f"u{i} " * 10) for i in range(60)], source="b"))
    frame = frame.unionByName(docs(*[(None, "copy " * 10)] * 60, (None, " "), (None, None), source="c"))
    rows = mixing.plan(frame).groupBy("source_size", "target").sum("taken").collect()
    assert sorted((r.target, r[2]) for r in rows) == sorted((float(t), t) for t in (1200, 1000, 500))
    out = mixing.apply(frame).collect()
    count = {s: [r.text for r in out if r.source == s] for s in "abc"}
    assert {s: len(x) for s, x in count.items()} == {"a": 120, "b": 100, "c": 50}
    assert len(set(count["b"])) == 60 and len(set(count["c"])) == 1
    again = mixing.apply(frame.repartition(5)).collect()
    assert sorted(r.text for r in again) == sorted(r.text for r in out)


def split_by_hand(points, shards, leaves, first, base):
    """Checks, node by node, that the leaves come from cuts along the widest dimension, near the aim."""
    if leaves == 1 or not points:
        return
    spread = [np.std([p[1][d] / 2**31 for p in points]) for d in range(3)]
    base = base or [round(s, 9) or 1.0 for s in spread]
    left = leaves // 2
    low = [p for p in points if shards[p[0]] < first + left]
    high = [p for p in points if shards[p[0]] >= first + left]
    wide = max(range(3), key=lambda d: (round(round(spread[d], 9) / base[d], 6), -d))
    if low and high:
        assert max((p[1][wide], p[2]) for p in low) <= min((p[1][wide], p[2]) for p in high)
    weight, most = sum(p[3] for p in points), max(p[3] for p in points)
    assert abs(sum(p[3] for p in low) - weight * left / leaves) <= 2 * sharding.SLACK * weight + most
    split_by_hand(low, shards, left, first, base)
    split_by_hand(high, shards, leaves - left, first + left, base)


def check_shards(frame, leaves):
    rows = sharding.shard(frame, -(-sharding.total_bytes(frame) // leaves) if leaves else 1).collect()
    assert len(rows) == frame.count()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, sizes


@pytest.mark.parametrize("leaves", [8, 5])
def test_shards_are_equal_and_keep_copies_together(docs, sf, leaves):
    rows, sizes = check_shards(sf("documents"), leaves)
    mean = sum(sizes.values()) / leaves
    assert len(sizes) == leaves and all(abs(s / mean - 1) < 0.12 for s in sizes.values())  # documents of up to 7 % of a shard
    texts = {r.doc_id: r.text for r in sf("documents").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1
    points = [(p.doc_id, (p.c0, p.c1, p.c2), p.h, p.size) for p in sharding.points(sf("documents")).collect()]
    split_by_hand(points, {r.doc_id: r.shard for r in rows}, leaves, 0, None)


def test_one_text_may_be_most_of_the_rows(docs):
    frame = docs(*["the same text again"] * 600, *[f"text {i} é" for i in range(40)], None, None, "")
    rows, sizes = check_shards(frame, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 60
    target = -(-sharding.total_bytes(frame) // 8)
    assert {tuple(r) for r in sharding.shard(frame.repartition(5), target).collect()} == {tuple(r) for r in rows}


def test_leaves_reach_the_target(docs):
    frame = docs(*[f"text {i} " + "word " * (i % 9) for i in range(200)], "very long " * 50_000)
    total = sharding.total_bytes(frame)
    assert sharding.shard(frame, total).select("shard").distinct().count() == 1
    sizes = check_shards(frame.where("doc_id < 200"), 7)[1]
    assert len(sizes) == 7 and max(sizes.values()) <= 1.1 * sum(sizes.values()) / 7
    # one document that is heavier than all others together
    rows, sizes = check_shards(frame, 4)
    assert len(rows) == 201 and max(sizes.values()) >= 500_000


def test_empty_table_has_no_shards(docs):
    assert sharding.shard(docs("a").limit(0), 16).count() == 0
    assert sharding.shard(docs("a", "b"), 1).count() == 2
