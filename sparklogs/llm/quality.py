"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; its label is known, its passages' are not. Every passage is encoded
(character classes, word shapes, repetition), a gated attention layer learned from document labels weighs the
passages, and the document's score is that of the weighted sum of their representations.

Defined cases: a null, empty or wordless text is one passage of zeros; without labels of both classes the score is
the share of label 1 (0.5 without any); repeated rows are scored each; an empty table gives no rows; other columns
are ignored. Whole texts are read: a long document has many passages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, materialize, mix, slices, string_parts
from .toxicity import sample

#: Labelled documents that the model is fitted on, at most, and passages of them, at most (some 30 MB of features): the
#: first whole documents by the hash of their id.
SAMPLE_ROWS, SAMPLE_PASSAGES = 5_000, 400_000
PASSAGE = 64
THRESHOLD = 0.7
HIDDEN, GATE, STEPS = 12, 8, 500

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:'\"-()?", "!", "#$%&*", "|<>{}[]=_/\\@^~`+", "\n")
_CLASS = np.full(256, len(_GROUPS) + 1, np.uint8)
_CLASS[128:] = len(_GROUPS)
_CLASS[[32, 9, 11, 12, 13]] = len(_GROUPS) + 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
KINDS = len(_GROUPS) + 1
WIDTH = KINDS + 9


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each row and the end)."""
    words = Words(data, offsets, lower=True)
    counts = words.counts()
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(words.starts):
        return out, first
    row = words.rows()
    inside = np.arange(len(row)) - words.first[row]
    at = first[row] + inside // PASSAGE
    n = np.bincount(at, minlength=first[-1]).astype(np.float32)
    full = np.flatnonzero(n)
    begin = np.searchsorted(at, full)
    a, b = words.starts[begin], np.concatenate((words.starts[begin[1:]], [len(data)]))
    size = np.maximum(1, b - a)
    kinds = _CLASS[data]
    for k in range(KINDS):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        out[full, k] = np.sqrt((total[b] - total[a]) / size)
    length = (words.ends - words.starts).astype(np.float32)
    mean = np.add.reduceat(length, begin) / n[full]
    out[full, KINDS] = np.log1p(mean)
    out[full, KINDS + 1] = np.log1p(np.sqrt(np.maximum(0, np.add.reduceat(length**2, begin) / n[full] - mean**2)))
    out[full, KINDS + 2] = np.add.reduceat((length == 1).astype(np.float32), begin) / n[full]
    same = np.zeros(len(row), np.float32)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (at[1:] == at[:-1])
    out[full, KINDS + 3] = np.add.reduceat(same, begin) / n[full]

    def fresh(keys: np.ndarray) -> np.ndarray:
        """Whether each word's key is the first of its kind."""
        order = np.argsort(keys, kind="stable")
        new = np.zeros(len(keys), np.float32)
        new[order] = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        return new

    out[full, KINDS + 4] = np.add.reduceat(fresh(mix(words.hashes ^ at.astype(np.uint64))), begin) / n[full]
    grams = words.grams(3)
    out[full, KINDS + 5] = np.add.reduceat(fresh(mix(grams ^ row.astype(np.uint64))), begin) / n[full]
    text = data[words.ends - 1]
    out[full, KINDS + 6] = np.add.reduceat((_CLASS[text] >= 4).astype(np.float32) * (_CLASS[text] <= 6), begin) / n[full]
    out[full, KINDS + 7] = np.log1p(n[full]) / 4
    out[full, KINDS + 8] = np.log1p(per[row[begin]]) / 6
    return out, first


@dataclass
class Model:
    """mean and scale of the features, and the layers: encoder w, b; attention v, u, a; output c, d."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]


def _forward(x: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    e = (t * s) @ p["a"]
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    alpha = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(alpha[:, None] * h, first[:-1])
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return {"h": h, "t": t, "s": s, "bag": bag, "alpha": alpha, "z": z, "y": y}


def _slopes(x: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray], f: dict[str, np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
    dy = (f["y"] - label) / len(label)
    dz = (dy[:, None] * p["c"])[f["bag"]]
    da = (dz * f["h"]).sum(1)
    de = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, first[:-1])[f["bag"]])
    dg = de[:, None] * p["a"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["alpha"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ dy, "d": dy.sum(keepdims=True), "a": (f["t"] * f["s"]).T @ de, "v": f["h"].T @ dt, "u": f["h"].T @ ds, "w": x.T @ dh, "b": dh.sum(0)}


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Adam over batches of bags; the seed is fixed, so equal input gives an equal model."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(7)
    shapes = {"w": (x.shape[1], HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (k not in "bd") for k, s in shapes.items()}
    m, v = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    bags = len(label)
    for step in range(1, steps + 1):
        pick = rng.permutation(bags)[:256]
        own = np.diff(first)[pick]
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
        starts = np.concatenate(([0], np.cumsum(own)))
        slopes = _slopes(x[at], starts, p, _forward(x[at], starts, p), label[pick])
        for k, g in slopes.items():
            g = g + decay * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """The model from at most `most` labelled rows with at most SAMPLE_PASSAGES passages, whose features alone come to the driver."""

    def encode(batches):
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for i, j in slices(offsets):
                x, first = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("label")[i:j], pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    rows = materialize(sample(docs, labels, column, most).mapInArrow(encode, "doc_id long, label int, bag binary"), "bags")
    place = F.xxhash64("doc_id")
    sizes = rows.groupBy(place.alias("place")).agg(F.sum(F.octet_length("bag")).alias("bytes")).toPandas().sort_values("place")  # at most `most` numbers
    inside, total = [], 0
    for at, size in zip(sizes["place"], sizes["bytes"], strict=True):
        if total + size <= SAMPLE_PASSAGES * WIDTH * 4:  # a document too long for what is left is passed over
            inside.append(int(at))
            total += size
    rows = rows.where(place.isin(inside)).toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    label = rows["label"].to_numpy(float)
    if not len(label) or label.min() == label.max():
        share = np.clip(label.mean() if len(label) else 0.5, 1e-6, 1 - 1e-6)
        zero = {"w": np.zeros((WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "v": np.zeros((HIDDEN, GATE)), "u": np.zeros((HIDDEN, GATE)), "a": np.zeros(GATE), "c": np.zeros(HIDDEN)}
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero | {"d": np.array([np.log(share / (1 - share))])})
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["bag"]]
    return train(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), label)


def probability(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    out = []
    for i, j in slices(offsets):
        x, first = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append(_forward((x - model.mean) / model.scale, first, model.layers)["y"])
    return np.concatenate(out) if out else np.zeros(0)


def score_column(model: Model):
    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(probability(*string_parts(pa.array(text, pa.large_string())), model))

    return quality


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", held_out().alias("held_out"), score_column(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
