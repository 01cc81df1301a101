import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparklogs.llm import jaccard, lattice


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_join(rows, k, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    return {i: (len(s), r) for (i, s), r in zip(sets.items(), roots(links, sets).values())}


def families(seed, n=40):
    rng = random.Random(seed)
    boiler = [f"b{j}" for j in range(50)]
    rows = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            base += boiler
        for _ in range(rng.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
            text = " ".join(words)
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
@pytest.mark.parametrize("chunk, pivots, often", [(4, 2, 3), (2, 10**9, 10**9), (128, 8, 20)])
def test_join_against_brute_force(docs, monkeypatch, k, num, den, chunk, pivots, often):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rows = families(k)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "é É"), (907, rows[0][1]), (908, "x " * 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(*rows), k, num, den).collect()}
    assert got == brute_join(rows, k, num, den)


def test_join_odd_tables(docs):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "alone here now then"), (2, "A B C D E"), (3, "z")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 1), (3, 3)], key=str)
    assert jaccard.join(docs(*rows).limit(0)).count() == 0


def test_one_family_in_many_blocks_and_a_passage_in_all(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(5)
    passage = [f"p{j}" for j in range(60)]
    base = [f"w{j}" for j in range(120)]
    rows = [(i, " ".join(f"v{i}x" if j == rng.randrange(120) else w for j, w in enumerate(base))) for i in range(90)]
    rows += [(i, " ".join(passage + [f"o{i}t{j}" for j in range(rng.randint(8, 14))])) for i in range(100, 160)]
    rows += [(i, " ".join(passage)) for i in range(160, 163)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(*rows)).collect()}
    assert got == brute_join(rows, 4, 85, 100)


def test_keep_one_with_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = families(3, 6)
    names = ["id_", "hash_", "text_hash_", "f", "f_", "hash", "row", "none", "id", "doc", "of", "first", "meet"]
    frame = docs(*rows, rows[0]).withColumns({n: F.lit("x") for n in names})
    out = jaccard.keep_one(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({r for _, r in brute_join(rows, 5, 80, 100).values()})
    assert jaccard.join(frame).count() == len(rows) + 1


def test_keep_one(docs):
    rows = families(7, 12)
    frame = docs(*rows, rows[0], (None, "no id"), (800, None))
    out = jaccard.keep_one(frame)
    want = {r for _, r in brute_join([*rows, (800, None)], 5, 80, 100).values()}
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert out.where("doc_id IS NULL").count() == 1


def test_null_ids_link_others(docs):
    words = [f"w{i}" for i in range(60)]
    one, two, three = " ".join(words), " ".join([*words[3:], "x1", "x2", "x3"]), " ".join([*words[6:], "x1", "x2", "x3", "y1", "y2", "y3"])
    alone = " ".join(f"v{i}" for i in range(60))
    rows = [(1, one), (2, three), (None, two), (None, two), (None, alone), (None, alone + " end"), (None, None), (4, alone[::-1]), (4, "z")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (None, 1), *[(None, None)] * 3, (4, 4), (4, 4)], key=str)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs(*rows, (4, "z"), (4, None), (None, "")), 4, 85, 100).collect()]
    null = [t for i, t in kept if i is None and t and t.startswith("v")]
    assert len(null) == 1 and null[0] in (alone, alone + " end")
    assert sorted(((i, t) for i, t in kept if (i, t) != (None, null[0])), key=str) == sorted([(1, one), (4, alone[::-1]), (4, "z"), (4, None), (None, None), (None, "")], key=str)


def brute_links(rows):
    unit, links = {}, []
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (label, x / np.linalg.norm(x))
    for a, (la, x) in unit.items():
        for b, (lb, y) in unit.items():
            if a < b and la == lb and len(x) == len(y) and x @ y >= 0.93:
                links.append((a, b))
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = roots(links, [i for i, _, _ in rows])
    return {i: (degree[i], root[i], root[i] == i) for i, _, _ in rows}, len(links)


def vectors(seed=0, n=60, width=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = rng.normal(size=width)
        for _ in range(rng.choice([1, 2, 8, 40] if c < 6 else [1, 2, 5])):
            v = base / np.linalg.norm(base) + rng.normal(size=width) * rng.choice([0.0, 0.01, 0.03])
            rows.append((len(rows), [float(x) for x in v], int(c % 3) if c % 17 else None))
    odd = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] + [1.0] * (width - 1), [1e300] * width, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, n_links string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block, size", [(3, (1, 1.5)), (2048, (2, 2.0))])
def test_embedding_links(spark, monkeypatch, block, size):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "SIZES", (size,))
    rows = vectors()
    want, n = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.links(frame_of(spark, rows)).collect()}
    assert got.keys() == want.keys() and n > 100
    assert all(g[0] <= want[i][0] for i, g in got.items())
    assert sum(g[0] for g in got.values()) >= 0.97 * 2 * n
    assert np.mean([got[i] == want[i] for i in want]) > 0.95


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    plans = {n: lattice.plan(n) for n in (100, 5_000, 500_000)}
    assert [p.points for p in plans.values()] == sorted(p.points for p in plans.values()) and plans[500_000].points > 1
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(3000, 64))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    for cos, least in ((0.931, 0.9), (0.95, 0.95), (0.98, 0.99)):
        z = cos * x + np.sqrt(1 - cos**2) * y
        for p in plans.values():
            a, b = (lattice.cells(v, lattice.projections(64, p)) for v in (x, z))
            assert ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2)).mean() >= least


def test_e8_decoding():
    rng = np.random.default_rng(5)
    y = rng.normal(0, 2, (400, 8))
    p = lattice.nearest(y)
    even = (p % 2 == 0).all(1)
    assert (even | (p % 2 != 0).all(1)).all() and (p.sum(1) % 4 == 0).all()
    assert len(lattice.SHORTEST) == 240 and (np.square(lattice.SHORTEST).sum(1) == 8).all()
    here = ((y - p / 2) ** 2).sum(1)
    for v in lattice.SHORTEST:
        assert (((y - (p + v) / 2) ** 2).sum(1) >= here - 1e-9).all()


def test_repeated_and_null_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (3, None, 1), (4, [1.0, 0.0], None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in lattice.links(frame_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 0, 1), (None, 3, 1), (3, 0, 3), (4, 0, 4)], key=str)
    assert lattice.links(frame_of(spark, rows).limit(0)).count() == 0


def test_vectors_without_an_id_link_others(spark):
    at = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(1, at(0.0), 1), (None, at(0.3), 1), (2, at(0.6), 1), (None, at(3.0), 1), (5, at(4.5), 1), (5, at(1.5), 1), (6, at(1.6), 1), (7, at(4.4), 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.links(frame_of(spark, rows)).collect()), key=str)
    want = [(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]
    assert got == sorted(want, key=str)
