import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklogs.llm import centroids, entry, resampling

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_resample(rows, target, longest, buckets, seed, least, percent):
    def feats(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    docs, goal = [(i, *feats(t)) for i, t in rows], [feats(t)[1] for t in target]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for f in goal:
        for b in f:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for at, (i, n, f) in enumerate(docs):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, at])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, bits, block, portion", [(1, 12, 1 << 16, 1 << 20), (2, 3, 4, 60)])
def test_resampling_against_brute_force(docs, monkeypatch, longest, bits, block, portion):
    monkeypatch.setattr(resampling, "DIGIT_BITS", bits)
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "STEP_BYTES", portion)
    rng = random.Random(longest)
    words = ["Alpha", "beta", "Größe", "x1", "42", "naïve", "z"]
    rows = [(rng.choice([i, i, i // 2, -i, 10**15 + i]), rng.choice([" ", "-", "\n", "_ "]).join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(None, "alpha beta " * 20), (None, "alpha beta " * 20), (None, None), (7, ""), (8, None), (9, "wort " * 300), (2**63 - 1, "beta " * 30), (-(2**63), "beta " * 30)]
    target = ["beta größe beta", None, "x1 42 zebra"]
    goal = docs(*target).select("text", F.lit(1).alias("weight"))
    frame = docs(*rows).withColumns({c: F.lit("x") for c in ("weight", "rank", "part", "place", "key_0_", "block_", "digit_0_")})
    got = resampling.resample(frame, goal, longest, 50, 11, 5, 40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, target, longest, 50, 11, 5, 40)


def test_resampling_empty(docs):
    none = docs((1, "a")).limit(0)
    assert resampling.resample(none, none).count() == 0
    assert [tuple(r) for r in resampling.resample(docs((1, "a b " * 20)), none).collect()][0][1:2] == (40,)
    out = resampling.resample(docs(*["same words here now again " * 5] * 10), docs("other"), percent=50)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == [1, 2, 3, 4, 5]


def test_gains_follow_the_target():
    gain = resampling.gains(np.array([10, 0, 5]), np.array([0, 10, 5]))
    assert gain[1] > gain[2] > gain[0]


def brute_clusters(x, k, rounds, ids, seed):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i]))
    c = [x[i] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for v in x]

    for _ in range(rounds):
        near = assign()
        groups = [[v for v, (_, j) in zip(x, near, strict=True) if j == m] for m in range(len(c))]
        c = [[sum(p) // len(g) for p in zip(*g, strict=True)] if g else m for g, m in zip(groups, c, strict=True)]
    return assign(), c


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e9, 1e40])
def test_clusters_against_brute_force(spark, scale):
    rng = random.Random(5)
    x = [[rng.choice([-1, 1]) * scale * (rng.randrange(3) + rng.random() / 50) for _ in range(6)] for _ in range(80)]
    x += [list(x[0]), list(x[1])]  # copies
    ids = [rng.choice([i, i // 3]) for i in range(80)] + [None, None]
    rows = [(i, v, "e") for i, v in zip(ids, x, strict=True)]
    odd = [(900, None, "e"), (901, [1.0] * 5, "e"), (902, [None] * 6, "e"), (903, [float("nan")] * 6, "e"), (904, [float("-inf")] * 6, "e"), (905, [], "e")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster string")
    q = [[math.floor(1024 * int(v)) if abs(v) > 2**53 else math.floor(1024 * v) for v in r] for r in x]
    near, c = brute_clusters(q, 5, 4, ids, 3)
    most = 2**63 - 1
    want = sorted(
        (str(i), j, min(d, most), min(sum(min(e, most) for e, m in near if m == j), most), min(sum(min(e, most) for e, _ in near), most), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
        for i, (d, j) in zip(ids, near, strict=True)
    )
    got = centroids.clusters(frame, 5, 4, 3, 6)
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == want
    assert centroids.clusters(frame.limit(0), 5, 4, 3, 6).count() == 0
    assert centroids.clusters(frame, 5, 4, 3, 7).count() == 0


def test_search_saves_distances():
    rng = np.random.default_rng(1)
    c = rng.integers(-500, 500, (64, 1)) + rng.integers(-40, 40, (64, 16))
    x = rng.integers(-500, 500, (500, 1)) + rng.integers(-40, 40, (500, 16))
    search = centroids.Search(c)
    near, best = search.nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (best == d.min(1)).all() and search.compared < 500 * 64 / 4
    # ties go to the smaller number, equal sums or not
    twice = centroids.Search(np.array([[4, 0], [0, 4], [4, 0], [2, 2]]))
    assert twice.nearest(np.array([[4, 0], [1, 3], [3, 3]]))[0].tolist() == [0, 1, 3]


@pytest.mark.parametrize("name", ["op11_centroid_search", "op12_radix_resampling", "op13_wrapper_extraction"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda d: sorted(tuple("" if v is None or v != v else v if isinstance(v, str) else str(int(v)) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
    assert show(got) == show(want)
