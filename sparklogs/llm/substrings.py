"""Substring deduplication with prefix-partitioned suffix trees over words.

Every word sequence of WINDOW words that also starts earlier (smaller doc_id, or the same document and an earlier
start) is removed, wherever it covers words. The work is that of a generalised suffix tree, cut into groups:

1. Suffixes that can't lie below a deep node are left out. A window's anchor is its least 6-word prefix hash; equal
   windows have equal anchors at equal places, so an anchor that occurs once has no repeated window around it.
   Windows repeated within one document are seen there and then.
2. The suffixes at repeated anchors are grouped by a prefix of variable length: six words from the anchor on, for the
   windows that begin up to 14 words before it. A group of more than GROUP suffixes is split: the windows that begin 0
   to 7 words before the anchor have 13 words in common, those that begin 8 to 14 before it 14 words, and so on by
   halves up to the 20 words of one window. Each such suffix begins up to 14 words earlier and has the longer prefix;
   prefixes that occur once are dropped. A prefix of 20 words is one node however many leaves it has: its first leaf
   is a minimum, to which every task adds what it has.
3. Each group is sorted by its suffixes' words; neighbours' common prefixes give the internal nodes of its subtree,
   and with the words to the left of the anchor, the maximal repeats of WINDOW words and more. All leaves of such a
   node but the first are marked.
4. The marks go back to their documents, which drop the words they cover; runs of them are the `repeats`.

Words are compared as 64-bit hashes at aligned places of windows that share an anchor.

Defined cases: a null or blank text has no words and hashes the empty text; a null doc_id comes after all others;
rows with one doc_id are ordered by a 64-bit hash of their texts, and equal rows are read as one (neither is earlier);
texts shorter than a window lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix, over_groups, release, slices, string_parts

WINDOW, PREFIX = 20, 6
LEFT = WINDOW - PREFIX
#: Suffixes of one group: some 8 MB of words, and as much again as a matrix, in one task.
GROUP = 32_768
_LAST = (1 << 63) - 1
_C = np.uint64(0xD6E8FEB86659FD93)


def _extend(a: np.ndarray, b: np.ndarray, shift: int, length: int) -> np.ndarray:
    """Polynomial hashes of runs: those of a, then, `shift` words on, those of b, which are `length` words long."""
    out = a * np.uint64(pow(int(_C), length, 1 << 64))
    out[: len(b) - shift] += b[shift:]
    return out


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the PREFIX and the WINDOW words from each word on (6 = 4 + 2, 20 = 16 + 4)."""
    two = _extend(words, words, 1, 1)
    four = _extend(two, two, 2, 2)
    eight = _extend(four, four, 4, 4)
    sixteen = _extend(eight, eight, 8, 8)
    return mix(_extend(four, two, 4, 2)), mix(_extend(sixteen, four, 16, 4))


def _slide_min(y: np.ndarray, width: int) -> np.ndarray:
    """Minimum of y[i : i + width] for each i that has so many."""
    done, out = 1, y
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """Windows of consecutive rows: where they start, which repeat an earlier one of their row, and their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        self.row = words.rows()
        empty = np.zeros(0, np.int64)
        self.starts, self.repeat, self.anchor, self.prefix = empty, empty.astype(bool), empty, empty.astype(np.uint64)
        n = len(words.starts)
        if n < WINDOW:
            return
        self.prefix, full = runs(words.hashes)
        ok = np.flatnonzero(np.arange(n) + WINDOW <= words.first[1:][self.row])
        if not len(ok):
            return
        self.starts = ok
        own = mix(full[ok] ^ self.row[ok].astype(np.uint64) * _C)
        self.repeat = np.zeros(len(ok), bool)
        ordered = np.sort(own)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            some = np.flatnonzero(twice[at] == own)
            order = some[np.argsort(own[some], kind="stable")]
            self.repeat[order[1:][own[order[1:]] == own[order[:-1]]]] = True
        low = (self.prefix >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        self.anchor = (_slide_min(low, LEFT + 1)[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def anchors(self) -> np.ndarray:
        return np.unique(self.anchor[~self.repeat])


def _each(batch: pa.RecordBatch):
    data, offsets = string_parts(batch.column("text"))
    for i, j in slices(offsets):
        yield i, j, Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _base(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc (order), sub (tells apart texts of one doc_id; 0 where every doc_id is one row), doc_id and text of every
    document; and where a doc_id repeats, in which case equal rows are one document: doc_id, doc, sub of every row."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text")
    repeated = rows.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    if not repeated:
        return rows.withColumn("sub", F.lit(0).cast("long")), None
    rows = rows.withColumn("sub", F.xxhash64(F.coalesce("text", F.lit(""))))
    return materialize(rows.dropDuplicates(["doc", "sub"]), "documents"), rows.select("doc_id", "doc", "sub")


def _anchors(batches):
    for batch in batches:
        doc, sub = (batch.column(c).to_numpy() for c in ("doc", "sub"))
        for i, _, w in _each(batch):
            a = w.anchors()
            row = w.row[a] if len(a) else a
            columns = (w.prefix[a].view(np.int64), doc[i + row], sub[i + row], a - w.words.first[row])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc", "sub", "at"])


_SUFFIX = "h long, lo int, hi int, doc long, sub long, at long, before int, context binary"


def _suffixes(batches):
    """The neighbourhood of each repeated anchor: `before` words to its left, and up to WINDOW words from it on."""
    for batch in batches:
        doc, sub = (batch.column(c).to_numpy() for c in ("doc", "sub"))
        for i, j, w in _each(batch):
            wanted = batch.column("anchors")[i:j]
            counts = np.diff(wanted.offsets.to_numpy())
            at = wanted.flatten().field("pos").to_numpy()
            hot = wanted.flatten().field("hot").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(j - i), counts)
            place = w.words.first[row] + at
            first, last = w.words.first[row], w.words.first[row + 1]
            begin, end = np.maximum(first, place - LEFT), np.minimum(last, place + WINDOW)
            raw = w.words.data.tobytes()
            text = [raw[x:y] for x, y in zip(w.words.starts[begin].tolist(), w.words.ends[end - 1].tolist(), strict=True)]
            n = len(at)
            columns = (w.prefix[place].view(np.int64), np.zeros(n, np.int32), np.full(n, LEFT, np.int32), doc[i + row], sub[i + row], at, (place - begin).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(text, pa.binary()), pa.array(hot)], ["h", "lo", "hi", "doc", "sub", "at", "before", "context", "hot"]
            )


def _matrix(context: pa.Array, before: np.ndarray) -> np.ndarray:
    """Hashes of the words around each anchor, which stands in column LEFT; 0: no word."""
    m = np.zeros((len(before), LEFT + WINDOW), np.uint64)
    data, offsets = string_parts(context)
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        row = words.rows()
        m[i + row, np.arange(len(row)) - words.first[row] + LEFT - before[i + row]] = words.hashes | np.uint64(1)
    return m


def _halves(batches):
    """Suffixes for the windows that begin lo to hi words before the anchor, as those of either half of them."""
    for batch in batches:
        lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        m = _matrix(batch.column("context"), batch.column("before").to_numpy())
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid + 1, hi)):
            h, whole = np.zeros(len(lo), np.uint64), np.ones(len(lo), bool)
            for c in range(LEFT + WINDOW):
                inside = (c >= LEFT - a) & (c < LEFT - b + WINDOW)
                h = np.where(inside, mix(h * _C + m[:, c]), h)
                whole &= ~inside | (m[:, c] != 0)
            h = mix(h ^ (a * 64 + b + 1).astype(np.uint64))
            rows = pa.array(np.flatnonzero(whole))
            kept = [batch.column(c).take(rows) for c in ("doc", "sub", "at", "before", "context")]
            numbers = (h.view(np.int64), a.astype(np.int32), b.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(x).take(rows) for x in numbers), *kept], ["h", "lo", "hi", "doc", "sub", "at", "before", "context"])


def tree(table: pa.Table) -> pa.RecordBatch | None:
    """Marks of whole groups of suffixes: bit o of `mask` says that the window o words left of the anchor came earlier."""
    table = table.take(np.lexsort(tuple(table.column(c).to_numpy() for c in ("at", "sub", "doc"))))  # earliest first
    h, doc, sub, at = (table.column(c).to_numpy() for c in ("h", "doc", "sub", "at"))
    lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
    m = _matrix(table.column("context").combine_chunks(), table.column("before").to_numpy())
    right = m[:, LEFT:]
    order = np.lexsort(tuple(right[:, k] for k in range(WINDOW - 1, PREFIX - 1, -1)) + (h,))
    sorted_ = right[order]
    same = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 0)
    same[:, 0] &= h[order][1:] == h[order][:-1]
    common = np.where(same.all(1), WINDOW, np.argmin(same, axis=1))  # of neighbours: the depth of their node
    mask, left = np.zeros(len(h), np.int32), np.zeros(len(h), np.uint64)
    node = np.empty(len(h), np.uint64)
    for o in range(LEFT + 1):
        if o:
            left = mix(left * _C + m[:, LEFT - o])
        depth = WINDOW - o
        node[order] = np.concatenate(([0], np.cumsum(common < depth))).astype(np.uint64)
        there = np.flatnonzero((lo <= o) & (o <= hi) & (m[:, LEFT - o] != 0) & (right[:, depth - 1] != 0))
        if len(there) < 2:
            continue
        key = mix(node[there] * _C + left[there])
        by = np.argsort(key, kind="stable")
        key, leaf = key[by], there[by]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        start = at[leaf] - o
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        # one window that several anchors stand in is not earlier than itself
        later = (doc[leaf] != doc[leaf[first]]) | (sub[leaf] != sub[leaf[first]]) | (start != start[first])
        mask[leaf[later]] |= np.int32(1 << o)
    hit = np.flatnonzero(mask)
    if not len(hit):
        return None
    return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, sub, at, mask)], ["doc", "sub", "at", "mask"])


_REPEATS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MARK = "doc long, sub long, at long, mask int"


def _kept(batches):
    for batch in batches:
        counts, removed, digests, repeats = [], [], [], []
        for i, j, w in _each(batch):
            n = len(w.words.starts)
            gone = np.zeros(n + 1, np.int64)
            start = w.starts[w.repeat]
            marks = batch.column("marks")[i:j]
            per = np.diff(marks.offsets.to_numpy()) if marks.null_count == 0 else np.array([len(m) if m is not None else 0 for m in marks.to_pylist()])
            items = marks.flatten()
            if len(items):
                place = w.words.first[np.repeat(np.arange(j - i), per)] + items.field("pos").to_numpy()
                mask = items.field("mask").to_numpy()
                start = np.concatenate([start, *[(place - o)[mask >> o & 1 == 1] for o in range(LEFT + 1)]])
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
            out = np.cumsum(gone)[:n] > 0
            first = w.words.first
            total = np.concatenate(([0], np.cumsum(out)))
            raw = w.words.data.tobytes()
            for r in range(j - i):
                a, b = first[r], first[r + 1]
                keep = a + np.flatnonzero(~out[a:b])
                kept = b" ".join([raw[x:y] for x, y in zip(w.words.starts[keep].tolist(), w.words.ends[keep].tolist(), strict=True)])
                digests.append(hashlib.sha256(kept).hexdigest())
                turn = np.flatnonzero(np.diff(np.concatenate(([False], out[a:b], [False]))))
                repeats.append([{"start": x, "end": y} for x, y in turn.reshape(-1, 2).tolist()])
            counts.append(np.diff(first))
            removed.append(total[first[1:]] - total[first[:-1]])
        if counts:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "sub")), pa.array(np.concatenate(counts)), pa.array(np.concatenate(removed)), pa.array(digests), pa.array(repeats, _REPEATS)],
                ["doc_id", "doc", "sub", "n_words", "n_removed", "kept_sha256", "repeats"],
            )


def _trees(rows: DataFrame) -> DataFrame:
    """Marks of the groups of suffixes, each a subtree in one task."""
    return over_groups(rows.repartition("h"), "h", tree, _MARK, 20_000)


def _split_trees(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Marks of suffixes in groups that are too large: split by longer prefixes until groups fit or are one window; and
    the tables that they are read from."""
    marks, tables = None, []
    while True:
        # a prefix is at most as many words longer as LEFT, in at most four rounds
        rows = materialize(rows.mapInArrow(_halves, _SUFFIX), "longer")
        counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.max(F.expr("hi - lo")).alias("width")).where("n > 1")
        counts = materialize(counts, "prefixes")
        tables += [rows, counts]
        fit = _trees(rows.join(counts.where(f"n <= {GROUP}").select("h"), "h", "left_semi"))
        start = F.struct("doc", "sub", (F.col("at") - F.col("lo")).alias("start"))
        window = rows.join(counts.where(f"n > {GROUP} AND width = 0").select("h"), "h", "left_semi")
        first = window.groupBy("h").agg(F.min(start).alias("first")).withColumnRenamed("h", "h_")
        later = window.join(first, F.col("h") == F.col("h_")).where(start > F.col("first"))
        fit = fit.union(later.select("doc", "sub", "at", F.expr("shiftleft(1, lo) AS mask")))
        marks = fit if marks is None else marks.union(fit)
        large = counts.where(f"n > {GROUP} AND width > 0").select("h")
        if not large.limit(1).count():
            return marks, tables
        rows = rows.join(large, "h", "left_semi")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and repeats (runs of removed words: start, end) for every row."""
    base, repeats = _base(docs)
    anchors = base.select("doc", "sub", "text").mapInArrow(_anchors, "h long, doc long, sub long, at long")
    often = anchors.groupBy("h").count().where("count > 1").select(F.col("h"), (F.col("count") > GROUP).alias("hot"))
    place = F.struct(F.col("at").alias("pos"), "hot")
    wanted = anchors.join(often, "h").groupBy("doc", "sub").agg(F.collect_list(place).alias("anchors"))
    wanted = materialize(wanted, "anchors")
    suffixes = base.select("doc", "sub", "text").join(wanted, ["doc", "sub"]).mapInArrow(_suffixes, _SUFFIX + ", hot boolean")
    suffixes = materialize(suffixes, "suffixes")
    marks, tables = _trees(suffixes.where("NOT hot").drop("hot")), []
    if suffixes.where("hot").limit(1).count():
        more, tables = _split_trees(suffixes.where("hot").drop("hot"))
        marks = marks.union(more)
    marks = marks.groupBy("doc", "sub").agg(F.collect_list(F.struct(F.col("at").alias("pos"), "mask")).alias("marks"))
    marks = materialize(marks, "marks")
    release(wanted, suffixes, *tables)
    none = F.expr("CAST(array() AS array<struct<pos: long, mask: int>>)")
    out = base.join(marks, ["doc", "sub"], "left").select("doc_id", "doc", "sub", "text", F.coalesce("marks", none).alias("marks"))
    kinds = "n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: int, end: int>>"
    out = out.mapInArrow(_kept, f"doc_id long, doc long, sub long, {kinds}")
    if repeats is not None:
        out = repeats.join(out.drop("doc_id"), ["doc", "sub"])
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats")
