import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparklogs.llm import pieces

ODD = ["", " ", "  a  b ", "▁x▁ ▁", "a\n\n b\tc\r\n", "é\U0001f600 日本 \x00 ▁", "x" * 5000, "<s> </s> <0x41> <unk>", "ﬁ ½    ", "The quick brown fox."]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary()


@pytest.fixture(scope="module")
def lattices(vocabulary):
    return pieces.Lattices(vocabulary)


@pytest.mark.parametrize("text", ODD)
def test_lossless(lattices, vocabulary, text):
    for key in range(20):
        ids, _ = lattices.sample([text], np.array([key], np.uint64))
        assert pieces.decode_ids(ids.tolist(), vocabulary.table()) == text


@pytest.mark.parametrize("word", ["hello", "unable", "日本x"])
def test_distribution_is_that_of_all_segmentations(lattices, vocabulary, word):
    known = {p: (i, w) for i, (p, w) in enumerate(zip(vocabulary.pieces, vocabulary.weights)) if w > -math.inf}

    def ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in ways(s[k:]):
                    yield (known[s[:k]][0], *rest), w + known[s[:k]][1]

    weights = {k: math.exp(w) for k, w in ways(pieces.SPACE + word)}
    total, n = sum(weights.values()), 20_000
    ids, cuts = lattices.sample([word] * n, pieces.keys_of(pa.array(range(n), pa.int64()), 1))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]))
    assert set(seen) <= set(weights)
    for k, w in weights.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_same_row_same_pieces_whatever_stands_beside(lattices, vocabulary):
    texts = ["some words to sample here", "and others that follow", "some words to sample here"]
    keys = np.array([5, 6, 5], np.uint64)
    ids, cuts = lattices.sample(texts, keys)
    parts = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    assert parts[0] == parts[2]
    fresh = pieces.Lattices(vocabulary)
    assert fresh.sample([texts[1]], keys[1:2])[0].tolist() == parts[1]
    fresh.clear()
    assert fresh.sample([texts[0]], keys[:1])[0].tolist() == parts[0]
    other = [fresh.sample([texts[0]], np.array([k], np.uint64))[0].tolist() for k in range(30)]
    assert len({tuple(o) for o in other}) > 5


def test_columns(docs, vocabulary):
    frame = docs(*ODD, None, (None, "no id"), (0, ""), (3, ODD[3]))
    out = pieces.encode(frame, vocabulary)
    rows = out.collect()
    assert len(rows) == frame.count() and all(r.lossless for r in rows if r.ids is not None)
    assert [(r.n_pieces, r.ids) for r in rows if r.doc_id == len(ODD)] == [(0, None)]
    assert len({tuple(r.ids) for r in rows if r.doc_id == 3}) == 1
    back = {(r.doc_id, r.text) for r in pieces.decode(out, vocabulary).collect()}
    assert back == {(r.doc_id, r.text) for r in frame.collect()}
    assert sorted(map(str, pieces.encode(frame.repartition(5), vocabulary).collect())) == sorted(map(str, rows))
    assert pieces.encode(frame.limit(0), vocabulary).count() == 0


def test_driver_documents(sf, vocabulary):
    out = pieces.encode(sf("documents"), vocabulary)
    assert out.where("lossless").count() == sf("documents").count()
