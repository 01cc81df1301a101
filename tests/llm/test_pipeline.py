"""The corpus pipeline, stage by stage, on documents with planted cases; and the registered queries."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparklogs.llm import entry, jaccard, secrets
from sparklogs.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of documents and labels: toxic ones, near copies, secrets, three sources."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(240):
        words = [f"w{rng.randrange(400)}" for _ in range(50)]
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(50)] = "grobnik"
        if i % 10 == 1:
            words[3] = "token=abcdefgh1234"
        docs.append((i, " ".join(words), "en", f"src{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[i][1] + " end", "en", "src0") for i in range(1, 40) if i % 6]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {d[0]: d for d in docs}


def test_stages(spark, folder):
    path, docs = folder
    frame, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or frame.columns
        assert frame.columns == columns, name
        frame = stage(spark, frame, path)
        seen.append(frame.collect())
    clean, single, masked, mixed, encoded = seen
    want = [i for i in docs if not (i < 240 and i % 6 == 0)]
    assert sorted(r.doc_id for r in clean) == sorted(want)
    assert sorted(r.doc_id for r in single) == [i for i in sorted(want) if i < 1000]
    assert len(masked) == len(single) and not any(secrets.find(r.text) for r in masked) and sum("[SECRET]" in r.text for r in masked) > 10
    taken = {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    total = sum(len(r.text.split()) for r in masked)
    assert sum(taken.values()) == pytest.approx(1.5 * total, rel=0.05)
    size = {s: sum(len(r.text.split()) for r in masked if r.source == s) for s in taken}
    assert all(taken[s] <= 2 * size[s] for s in taken) and taken["src0"] == 2 * size["src0"]
    assert len(encoded) == len(mixed) and all(r.lossless for r in encoded)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, encoded))


def test_stages_on_odd_rows(spark, folder, tmp_path):
    """Nulls in every column, blank and long texts, repeated rows, clashing extra columns; and an empty table."""
    path, docs = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    odd = [
        (None, None, None, None, None), (None, "", "en", "src0", 0), (7001, None, "en", None, None), (7002, " \n", None, "src1", 2), (None, "an id less text", "en", None, 1),
        (7003, "y" + " tail of words" * 30_000, "fr", "src2", 9), (7003, "another text of the same id", "fr", "src2", 9), docs[1] + (9,), docs[1] + (9,),
    ]
    names = ["row", "id", "id_", "hash", "blob", "findings", "found", "label", "score", "of_", "left_", "copies_", "epoch_", "f", "none"]
    whole = frame.unionByName(spark.createDataFrame(odd, frame.schema)).withColumns({n: F.lit("x") for n in names})
    here = str(tmp_path / "odd")
    whole.write.parquet(f"{here}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{here}/labels.parquet")
    for table in (whole, whole.limit(0)):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            before, out = out, stage(spark, out, here)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns, name
                out = materialize(out, "stage")
            if name == "n-gram Jaccard join" and table is whole:
                kept = [(r.doc_id, r.text) for r in out.collect()]
                assert kept.count((1, docs[1][1])) == 1 and (7003, odd[6][1]) in kept and (7003, odd[5][1]) in kept and (7001, None) in kept
                assert len(kept) == len({(i, t) for i, t in kept}) and kept.count((None, None)) == 1
        rows = out.collect()
        assert all(r.lossless for r in rows) and bool(rows) == (table is whole)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.mark.parametrize("name", ["op9_blob_ledger", "op10_source_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    show = lambda x: x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(show(got), show(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_has_a_row_for_each_input_row(spark, name):
    table = "embeddings" if name.startswith("op8") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    out = entry.queries()[name](spark, SF)
    key = "vec_id" if name.startswith("op8") else "doc_id"
    assert out.count() == n == out.select(key).distinct().count()


def test_pipeline_join_parameters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.one_of_near_copies(spark, docs, SF).count() == jaccard.join(docs, 5, 80, 100).select("component_id").distinct().count()
