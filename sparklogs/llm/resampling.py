"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Features are runs of words, hashed to buckets. One pass counts the buckets of all documents and of the target texts
(each task sums an array of counts, Spark adds them up), and a bucket's gain is the scaled logarithm of the ratio of its
smoothed shares. A second pass scores: a document's weight is the sum of the gains at its features' buckets, taken from
the array of all gains, and its score adds noise that its id draws, so that the highest scores are a sample without
replacement in proportion to the importance.

Ranks come from a least-significant-digit radix sort. The key is composite: score descending, then the places of ids,
the digits are those that the range of the values needs. In every pass a row's place is given: blocks of BLOCK places
count their digits, prefix sums over (digit, block) are the destinations of each block's rows of a digit, and a row goes
to that offset plus its number among them, which keeps the earlier order. After the last digit a row's place is its rank.
A pass shuffles rows by (block, digit), at most BLOCK rows a group; the totals of a digit are one row per digit, and its
offsets one row per block.

Defined cases: a null text has no words; null ids draw by the empty text and come behind equal scores of other ids;
repeated rows are rows each, rows of equal score and id keep the order of the files; an empty table gives no rows, an
empty target makes rare words likelier; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, materialize, release, slices, string_parts

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bits of a digit of the radix sort, and places of a block.
DIGIT_BITS, BLOCK = 12, 1 << 16
#: Features whose bucket a task remembers.
REMEMBERED = 1 << 18

#: Every byte that is no part of a word as a space, A-Z as a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of a feature, by its bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out


def runs(words: list[bytes], longest: int = LONGEST, behind: int = 0) -> list[bytes]:
    """All runs of 1 to `longest` words that end behind the first `behind` of them."""
    out = words[behind:]
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(max(0, behind - n + 1), len(words) - n + 1)]
    return out


def _portions(folded: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of STEP_BYTES of a folded text at a time, cut between words."""
    at, tail = 0, []
    while at < len(folded):
        end = folded.find(b" ", at + STEP_BYTES) if at + STEP_BYTES < len(folded) else -1
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        yield len(words), runs(tail + words, longest, len(tail)) if longest > 1 else words
        tail = (tail + words)[1 - longest :] if longest > 1 else []
        at = end


def _found(batch: pa.RecordBatch, names: _Buckets, longest: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their numbers of words, of features, buckets of all their features) for about STEP_BYTES at a time; a
    longer text comes in several portions."""
    data, offsets = string_parts(batch.column("text"))
    for low, high in slices(offsets, STEP_BYTES):
        folded = data[offsets[low] : offsets[high]].tobytes().translate(_FOLD)
        cuts = (offsets[low : high + 1] - offsets[low]).tolist()
        if high - low == 1:
            for words, found in _portions(folded, longest):
                yield slice(low, high), np.array([words]), np.array([len(found)]), np.array([names[w] for w in found], np.int64)
            continue
        words, many, flat = [], [], []
        for i in range(high - low):
            mine = folded[cuts[i] : cuts[i + 1]].split()
            words.append(len(mine))
            mine = runs(mine, longest) if longest > 1 else mine
            many.append(len(mine))
            flat += [names[w] for w in mine]
        yield slice(low, high), np.array(words), np.array(many), np.array(flat, np.int64)


def counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts: an array of `buckets` numbers, on the driver."""

    def run(batches):
        names, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _found(batch, names, longest):
                total += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's smoothed shares in target and source)."""
    buckets = len(source)
    up = (target + 1).astype(np.float64) * float(int(source.sum()) + buckets)
    down = (source + 1).astype(np.float64) * float(int(target.sum()) + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document, and where it lies: part and place in it."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        names, part, place = _Buckets(len(gain)), TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            words, many, weight = (np.zeros(n, np.int64) for _ in range(3))
            for rows, count, features, found in _found(batch, names, longest):
                sums, ends = np.concatenate(([0], np.cumsum(gain[found]))), np.cumsum(features)
                words[rows] += count
                many[rows] += features
                weight[rows] += sums[ends] - sums[ends - features]
            at = [np.full(n, part, np.int64), np.arange(place, place + n)]
            place += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, many, weight, *at))], ["doc_id", "n_words", "n_features", "weight", "part", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, part long, place long")


def noise(seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel number that the id draws)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, keys: list[Column], block: str, place: str) -> DataFrame:
    """rows with rank (from 1) in ascending order of keys, whole numbers with nulls last; (block, place) is unique."""
    named = rows.withColumns({f"key_{i}_": k.cast("long") for i, k in enumerate(keys)})
    each = [(f, f"key_{i}_") for i in range(len(keys)) for f in ("min", "max")]
    bounds = named.agg(*[F.expr(f"{f}({c})").alias(f"{f}_{c}") for f, c in each], *[F.max(F.col(f"key_{i}_").isNull()).alias(f"null_{i}") for i in range(len(keys))]).first()
    digits: list[Column] = []  # the least significant first
    for i in reversed(range(len(keys))):
        key, low, high = F.col(f"key_{i}_"), bounds[f"min_key_{i}_"], bounds[f"max_key_{i}_"]
        if low is not None and low < high:
            narrow = high - low < 1 << 62
            # the distance from the least value, or where a long can't hold it all bits with the sign's turned: read without sign
            value, bits = (key - F.lit(low), (high - low).bit_length()) if narrow else (key.bitwiseXOR(F.lit(-(1 << 63))), 64)
            value = F.coalesce(value, F.lit(0).cast("long"))
            digits += [F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for shift in range(0, bits, DIGIT_BITS)]
        if bounds[f"null_{i}"]:
            digits.append(key.isNull())
    names = [f"digit_{d}_" for d in range(len(digits))]
    columns = [*rows.columns]
    state = named.select(*columns, F.col(block).alias("block_"), F.col(place).alias("place_"), *[d.cast("int").alias(n) for d, n in zip(digits, names, strict=True)])
    if not names:  # all keys are equal
        names, state = ["digit_0_"], state.withColumn("digit_0_", F.lit(0))
    before = None
    for i, digit in enumerate(names):
        count = state.groupBy("block_", digit).agg(F.count("*").alias("n"))
        if i == 0:
            count = materialize(count, "digits")
        totals = count.groupBy(digit).agg(F.sum("n").alias("n"))  # one row per digit
        totals = totals.select(digit, (F.sum("n").over(Window.orderBy(digit)) - F.col("n")).alias("first_"))
        inside = F.sum("n").over(Window.partitionBy(digit).orderBy("block_")) - F.col("n")
        offsets = count.select("block_", digit, inside.alias("inside_")).join(F.broadcast(totals), digit)
        offsets = offsets.select("block_", digit, (F.col("first_") + F.col("inside_")).alias("offset_"))
        number = F.row_number().over(Window.partitionBy("block_", digit).orderBy("place_")) - 1
        moved = state.withColumn("number_", number).join(offsets, ["block_", digit])
        at = F.col("offset_") + F.col("number_")
        state = moved.select(*columns, F.floor(at / BLOCK).alias("block_"), at.alias("place_"), *names[i + 1 :])
        if i + 1 < len(names):
            state = materialize(state, "pass")
            if before is not None:
                release(before)
            before = state
    return state.select(*columns, (F.col("place_") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank of the documents that aren't drawn is null."""
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed))
    scored = materialize(scored, "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    many = scored.where(F.col("n_words") >= least_words).select(*out, "part", "place")
    order = ranked(many, [-F.col("score"), F.col("doc_id")], "part", "place")
    drawn = many.agg(F.count("*")).first()[0] * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    few = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return order.select(*out, rank.cast("long").alias("rank")).union(few)
