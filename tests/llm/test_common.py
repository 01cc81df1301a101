import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklogs.llm import common


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Zé\n\t\x0b\x1c▁", max_size=12)), max_size=6))
def test_words(texts):
    data, offsets = common.string_parts(pa.array(texts, pa.string()))
    words = common.Words(data, offsets, lower=True)
    got = [[bytes(words.data[a:b]).decode() for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [w.replace("Z", "z") for ws in got for w in ws]
    assert len(set(words.hashes.tolist())) == len(set(flat))
    assert all((words.hashes[i] == words.hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_sliced_columns():
    column = pa.array(["a b", None, "c", "dd e"]).slice(1, 2)
    data, offsets = common.string_parts(column)
    assert bytes(data) == b"c" and offsets.tolist() == [0, 0, 1]
    assert list(common.slices(np.array([0, 5, 5, 50, 60]), 10)) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
