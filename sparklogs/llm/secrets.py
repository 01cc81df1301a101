"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every document is a path to a blob, the SHA-256 of its text. The ledger holds what was found in each
blob under each rule version. `record` reduces the rows of an increment to one text per blob (a partial aggregate, so a
text with a third of all rows is one row per task), leaves out the pairs of blob and rule version that the ledger knows,
scans each unseen blob once and adds it. `findings` joins the ledger back to all paths.

Two writers may add a blob both; it is read once, as equal blobs have equal findings.

Defined cases: a null text is the empty blob; null ids and repeated rows are rows each, with the findings of their
blob; an empty table gives no rows; other columns, whatever their names, are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: A rule: kind, pattern, group that must be long enough, least length. The order is the order of kinds.
BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: What the second rule version finds besides: headers of private keys, bearer tokens, prefixed personal tokens.
MORE_RULES = (
    ("private", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("bearer", re.compile(r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"), 0, 1),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1),
)
RULES = {1: BASE_RULES, 2: BASE_RULES + MORE_RULES}
RULE_VERSION = 2
BASE_KINDS = tuple(rule[0] for rule in BASE_RULES)
#: Substrings without which a rule can't match; those of assign in lower case.
_NEEDS = {"access": ("AKIA",), "private": ("-----BEGIN",), "bearer": ("earer",), "github": ("_",)}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
FINDINGS = "array<struct<kind: string, start: int, end: int>>"


def find(text: str, rules=RULES[RULE_VERSION]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then by kind."""
    low = text.encode().lower()
    out = []
    for place, (kind, pattern, group, least) in enumerate(rules):
        if kind == "assign" and not any(w in low for w in _WORDS) or not all(n in text for n in _NEEDS.get(kind, ())):
            continue
        out += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _scan(rules):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def step(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "", rules)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])

    return step


def _blob(text="text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def new_ledger(spark) -> str:
    """A path for an empty ledger in the shared folder."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def ledger(spark, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """What has been scanned under this rule version: blob, findings. No folder at `path` is an empty ledger."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"blob binary, findings {FINDINGS}")
    rows = spark.read.schema(f"blob binary, findings {FINDINGS}, rule_version int").parquet(path)
    return rows.where(F.col("rule_version") == rule_version).select("blob", "findings").dropDuplicates(["blob"])


def record(docs: DataFrame, path: str, rule_version: int = RULE_VERSION, rules=None) -> None:
    """Scan the blobs of docs (doc_id, text) that the ledger at `path` doesn't know under rule_version, and add them."""
    rules = RULES[rule_version] if rules is None else rules
    # one text for each blob in every task first, so a text with a third of all rows is a row per task from then on
    one = docs.select("text", _blob().alias("blob")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = one.join(ledger(docs.sparkSession, path, rule_version).select("blob"), "blob", "left_anti")
    fresh = unseen.select("blob", "text").mapInArrow(_scan(rules), f"blob binary, findings {FINDINGS}")
    fresh.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(path)


def findings(docs: DataFrame, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """doc_id, blob and findings of every row, as far as the ledger knows its blob."""
    # blobs without findings need no row of their own here; few are left, and copies are split by the engine
    found = ledger(docs.sparkSession, path, rule_version).where(F.size("findings") > 0)
    return docs.select("doc_id", _blob().alias("blob")).join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.from_json(F.lit("[]"), FINDINGS)).alias("findings")
    )


def scan(docs: DataFrame, path: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """doc_id, blob and findings of every row; unseen blobs are added to the ledger at `path` (default: a new one)."""
    path = path or new_ledger(docs.sparkSession)
    record(docs, path, rule_version)
    return findings(docs, path, rule_version)


def increments(docs: DataFrame, parts: int = 2) -> list[DataFrame]:
    """docs as they came in: `parts` ranges of doc_id of about equal size, rows without an id in the last."""
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        after = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
        until = F.lit(True) if high is None else F.coalesce(F.col("doc_id") <= high, F.lit(False))
        out.append(docs.where(after & until))
    return out


def spans(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: str, found) -> str:
    """text with each span, overlapping ones as one, replaced by [SECRET]."""
    out, at = [], 0
    for start, end in sorted((f["start"], f["end"]) for f in found):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with every secret that the ledger's scan found replaced by [SECRET], and n_chars as it is then.

    Blobs that the ledger at `path` (default: a new one) knows aren't scanned again.
    """
    path = path or new_ledger(docs.sparkSession)
    record(docs, path)
    found = ledger(docs.sparkSession, path).where(F.size("findings") > 0)

    @F.pandas_udf("string")
    def hide(text, found):
        import pandas as pd

        return pd.Series([masked(t, f) if f is not None else t for t, f in zip(text, found, strict=True)])

    # whatever other columns are called, they don't clash
    out = docs.select(F.struct("*").alias("row")).withColumn("blob", _blob("row.text")).join(found, "blob", "left")
    text = F.when(F.col("findings").isNotNull(), hide("row.text", "findings")).otherwise(F.col("row.text"))
    out = out.select("row", "findings", text.alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("findings").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")
