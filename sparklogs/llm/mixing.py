"""Mixing sources to target weights: random keys, range buckets, distributed prefix sums, exact budgets.

Only DataFrame functions run here. Documents of a source are taken in the order of a hash-random key, those of one
doc_id by size and then by a hash of the text. The key's leading bits name a range bucket, so that bucket sums give
every bucket's offset; only the bucket in which the budget ends is looked into, and so on down to one text: rows before
that cut are taken whole, rows after it are not. No window holds more than one row per bucket or one bucket's groups,
however large the source and however many rows share a doc_id.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in
order; a null doc_id counts as the empty text for the key; repeated rows are documents each, of which as many are
taken as the budget holds; without words in the whole table every target is 0; other columns, whatever their names, are
ignored by `plan` and kept by `apply`. The windows over sources hold one row per source: meant for up to some
hundred thousand sources, not for a source per web host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
#: Rows that one bucket of a source holds on average.
BUCKET_ROWS = 2_000


def _digest(seed: str):
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _size(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0))


def _text_hash(text: str = "text"):
    """63 bits of the text."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words, the order (digest, size, hash), and key: the digest's first 32 bits."""
    digest = _digest(seed)
    return docs.select(
        "doc_id",
        "source",
        _size().alias("size"),
        digest.alias("digest"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("key"),
        _text_hash().alias("hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, rows, target.

    Filling by weight with a cap for each source is min(cap, weight x level) for one level; sources are ordered by
    cap / weight, and the level is found where the next source's cap isn't reached. The windows below run over one
    row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("place", F.row_number().over(place) - 1)
    per = per.withColumn("weight", F.element_at(picked, (F.col("place") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(total).cast("double") * share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    # the first source, in that order, whose cap lies above its level fixes the level for all that follow
    per = per.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    per = per.withColumn("cut", F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(total)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("cut") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def _buckets(rows):
    return F.greatest(F.lit(1), F.ceil(rows / BUCKET_ROWS)).cast("long")


def _inside(rows: DataFrame, *by: str) -> DataFrame:
    """rows of the group `by` in whose running sum a source's `left` words end; left is what remains there, n its rows."""
    sums = rows.groupBy("source", "left", *by).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    found = sums.where("before <= left AND left < before + sum")
    found = found.select(F.col("source").alias("of"), *[F.col(c).alias(f"{c}_") for c in by], (F.col("left") - F.col("before")).alias("left"), "n")
    same = F.col("source").eqNullSafe(F.col("of"))
    for c in by:
        same = same & (F.col(c) == F.col(f"{c}_"))
    # one row per source
    return rows.drop("left", "n").join(materialize(found, "mix-cut"), same).drop("of", *[f"{c}_" for c in by])


def cuts(docs: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """sized docs, and for each source (of_) its source_size_, target_, how often it comes whole_, and where the round
    after that ends: at the n_ rows of equal digest_, size_ and hash_, of which left_ words are taken."""
    sizes = materialize(sized(docs, seed), "mix-sizes")
    goals = materialize(targets(sizes, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = (F.floor("target") - whole * F.col("source_size")).cast("long")
    at = goals.select(F.col("source").alias("of"), rest.alias("left"), _buckets(F.col("rows")).alias("buckets"))
    rows = sizes.join(at, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = _inside(rows.withColumn("bucket", F.expr("key * buckets div 4294967296")), "bucket")
    rows = _inside(rows, "digest", "size")
    # rows of one digest and size, in ranges of their texts' hashes
    rows = rows.withColumn("parts", _buckets(F.col("n"))).withColumn("part", F.expr("shiftright(hash, 31) * parts div 4294967296"))
    rows = _inside(_inside(rows, "part"), "hash")
    ends = rows.groupBy("source").agg(*[F.min(c).alias(f"{c}_") for c in ("digest", "size", "hash", "left", "n")])
    goals = goals.select(F.col("source").alias("of_"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"), whole.alias("whole_"))
    return sizes, materialize(goals.join(ends, F.col("of_").eqNullSafe(F.col("source")), "left").drop("source"), "mix-cuts")


def _numbered(rows: DataFrame) -> DataFrame:
    """rank_, from 0, of the rows at each source's cut: they are equal but for their place, which a salt settles."""
    salted = rows.withColumn("part_", F.floor(F.rand(0) * _buckets(F.col("n_"))))
    rows = materialize(salted, "mix-equal")
    earlier = Window.partitionBy("source").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", "part_").count()
    counts = counts.select(F.col("source").alias("at_"), F.col("part_").alias("of_part_"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset_"))
    rows = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("source", "part_").orderBy("hash_")) - 1)
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("at_")) & (F.col("part_") == F.col("of_part_")))
    return rows.withColumn("rank_", F.col("rank_") + F.col("offset_")).drop("at_", "of_part_", "offset_", "part_")


def _placed(rows: DataFrame, ends: DataFrame, digest, size, text_hash) -> tuple[DataFrame, DataFrame]:
    """rows with `first_`, whether they come before their source's cut; and those at the cut, with rank_."""
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("of_")))
    # sizes and hashes are read only where the digest doesn't decide
    near = digest == F.col("digest_")
    own = F.struct(digest.alias("d"), F.when(near, size).alias("s"), F.when(near, text_hash).alias("h"))
    end = F.struct(F.col("digest_").alias("d"), F.col("size_").alias("s"), F.col("hash_").alias("h"))
    at = F.coalesce(near & (size == F.col("size_")) & (text_hash == F.col("hash_")), F.lit(False))
    first = F.col("digest_").isNotNull() & (own < end)
    return rows.where(~at).withColumn("first_", first), _numbered(rows.where(at))


def plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document; taken sums to floor(target) per source."""
    sizes, ends = cuts(docs, seed, weights, share, most)
    apart, equal = _placed(sizes, ends, F.col("digest"), F.col("size"), F.col("hash"))
    part = F.when(F.col("first_"), F.col("size")).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_") - F.col("rank_") * F.col("size")))

    def shown(rows: DataFrame, part) -> DataFrame:
        taken = (F.col("whole_") * F.col("size") + part).cast("long").alias("taken")
        return rows.select("doc_id", "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), taken)

    return shown(apart, part).union(shown(equal, rest))


def apply(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The documents of the mix: each as often as the mix begins it, uncut; those it never takes are gone."""
    _, ends = cuts(docs, seed, weights, share, most)
    # whatever other columns are called, they don't clash
    packed = docs.select(F.struct("*").alias("row")).where(F.col("row.text").rlike(WORD))
    packed = packed.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))
    apart, equal = _placed(packed, ends, _digest(seed), _size("row.text"), _text_hash("row.text"))

    def copied(rows: DataFrame, begun) -> DataFrame:
        copies = (F.col("whole_") + begun.cast("int")).cast("int")
        rows = rows.withColumn("copies_", copies).where("copies_ > 0")
        return rows.withColumn("epoch_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select("row.*")

    return copied(apart, F.col("first_")).union(copied(equal, F.col("left_") > F.col("rank_") * F.col("size_")))
