import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparklogs.llm import substrings


def brute(rows):
    """n_words, n_removed, kept hash by row, in the order of doc_id."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if seen.setdefault(tuple(words[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i, t] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    shared = [[f"p{k}w{j}" for j in range(rng.randint(15, 60))] for k in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            part = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(part)), rng.randint(0, len(part))))
            words += rng.choice([part, part[a:b], [word() for _ in range(rng.randint(1, 40))], ["na"] * rng.randint(1, 70)])
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts


@pytest.mark.parametrize("group", [1, 3, 32_768])
def test_against_brute_force(docs, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = list(enumerate(made(group)))
    rows += [(100, None), (101, ""), (102, rows[7][1]), (None, rows[8][1]), (103, "É x " * 30), (104, "w " * 5000 + rows[3][1])]
    out = substrings.dedup(docs(*rows)).collect()
    got = {(r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in out}
    assert got == {i: v for (i, _), v in brute(rows).items()} and len(got) == len(rows)
    for r in out:  # maximal runs
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed and all(x.end - x.start >= 20 for x in r.repeats)
        assert all(x.end < y.start for x, y in zip(r.repeats, r.repeats[1:]))


def test_repeated_ids(docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "x " + text), (2, text), (3, "short")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs(*rows)).collect())
    assert got in ([(1, 30, 0), (1, 30, 0), (1, 31, 30), (2, 30, 30), (3, 1, 0)], [(1, 30, 30), (1, 30, 30), (1, 31, 0), (2, 30, 30), (3, 1, 0)])
    assert substrings.dedup(docs(*rows).limit(0)).count() == 0


def test_texts_without_id_whose_checksums_meet(docs):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    seen = {}
    for i in range(400_000):
        text = f"n{i} {one}" if i % 2 else f"n{i} more words first {two}"
        other = seen.setdefault(zlib.crc32(text.encode()) % (1 << 31), text)
        if other != text and (one in other) != (one in text):
            break
    else:
        raise AssertionError("no two checksums meet")
    rows = [(1, one), (2, two), (None, text), (None, other), *[(None, "same " + one)] * 3, (None, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 30, 0), (2, 30, 0), (None, 31, 30), (None, 34, 30), *[(None, 31, 30)] * 3, (None, 0, 0)], key=str)


def test_a_third_of_all_rows_is_one_text(docs, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 50)
    passage = " ".join(f"q{i}" for i in range(60))
    rows = [(i, passage) for i in range(0, 200)] + [(i, f"own{i} " + passage + f" tail{i}") for i in range(200, 400)] + [(i, f"other {i}") for i in range(400, 600)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs(*rows)).collect()}
    assert got == {i: v for (i, _), v in brute(rows).items()}


def test_sliding_minimum():
    y = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 7, 15, 16):
        assert (substrings._slide_min(y, width) == [y[i : i + width].min() for i in range(51 - width)]).all()
