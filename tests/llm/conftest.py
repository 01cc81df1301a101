import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents (doc_id, text, lang, source, n_chars and clashing columns) from texts or (id, text) pairs."""

    def build(*rows, source="s"):
        data = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, "en", source, len(t) if t is not None else None, "x", 7, 1.5) for i, t in data]
        schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, score double"
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
