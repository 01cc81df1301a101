"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity is at least num / den. The join is exact:

1. Equal sets are one set. Every set emits its first tokens in hash order, so many that linked sets share several of
   them. Tokens that only one set emits are dropped; sets with too few tokens left can't link with anything.
2. Sets are partitioned into groups by their least shared token, which similar sets have in common most likely, and
   large groups into blocks of CHUNK sets, with some members of the group in all of its blocks.
3. Blocks are opened for their own members first. The links found make components; those of a lower similarity, LOOSE,
   make families. Sets that share too few tokens with other components are done.
4. The families of the rest are dealt in blocks. The token-group matrix holds the union of tokens of each block,
   restricted to each set's rarest tokens that suffice to meet every partner. Tokens that lie in one component only
   are struck out. A set queries the blocks that hold one of its tokens from another component, as far as the sizes of
   the block's members and the tokens left behind that one allow a link; a block is opened if the query's overlap with
   the block's token union reaches the bound, and its members are then compared exactly.

No list of pairs leaves a task: links are reduced to each member's least linked member. Sets are known by a 64-bit
hash of their tokens, tokens by 64-bit hashes. Tokens that a sample finds in many sets are shared for certain: they
are dealt by set, so that no task gets all sets of one token.

Defined cases: a null, empty or blank text has no set and links with nothing; shorter texts than a shingle are one
shingle; null doc_ids take part, but a component takes its id from ids that aren't null (it has none if all are);
repeated rows link as equal texts do, and different texts under one doc_id are sets of their own; an empty table gives
no rows; other columns, whatever their names, are ignored by `join` and kept by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, components, gram_hashes, local_roots, materialize, mix, over_groups, release, slices, string_parts

#: Sets of one block, and members of a group that all of its blocks have.
CHUNK, PIVOTS = 128, 8
#: Similarity, in percent, from which sets are of one family.
LOOSE = 50
#: Texts that are sampled for tokens of many sets, sets of the sample that make a token one, and such tokens at most:
#: they decide where rows are dealt to, not what is found.
SAMPLED, OFTEN, MOST_OFTEN = 20_000, 20, 100_000


def _least(n, num: int, den: int):
    """Tokens that a set of n must share to link: ceil(n * num / den)."""
    return -(-n * num // den)


def _slack(n: int, num: int, den: int) -> int:
    return n - _least(n, num, den)


def _prefix(n: int, num: int, den: int) -> int:
    """Tokens that a set of n emits: the slack, and 1 + slack // 2 that linked sets share at least."""
    m = _slack(n, num, den)
    return min(n, m + m // 2 + 1)


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct tokens) of every row that has words."""
    data, offsets = string_parts(batch.column("text"))
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        grams = gram_hashes(words.hashes, k)
        for r in range(j - i):
            a, b = words.first[r], words.first[r + 1]
            if b - a >= k:
                yield i + r, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield i + r, mix(gram_hashes(words.hashes[a:b], int(b - a))[:1] + np.uint64(b - a))


def _name(tokens: np.ndarray) -> int:
    h = mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
    return int(h.view(np.int64)[0])


def _compare(tokens: list[np.ndarray], queries: np.ndarray, members: np.ndarray, comps: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of a query and a member: those of different components that link, and those of one family."""
    sizes = np.array([len(t) for t in tokens])
    values, at = np.unique(np.concatenate(tokens), return_inverse=True)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    often = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    owner, at = owner[keep], column[at[keep]]
    both = np.zeros((len(queries), len(members)), np.float32)
    as_query, as_member = np.full(len(tokens), -1), np.full(len(tokens), -1)
    as_query[queries], as_member[members] = np.arange(len(queries)), np.arange(len(members))
    width = 4096
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(at, [low, low + width])
        x, y = np.zeros((len(queries), width), np.float32), np.zeros((len(members), width), np.float32)
        q, m = as_query[owner[a:b]], as_member[owner[a:b]]
        x[q[q >= 0], at[a:b][q >= 0] - low] = 1
        y[m[m >= 0], at[a:b][m >= 0] - low] = 1
        # a query whose overlap with the union of the members falls short opens nothing
        both += x @ y.T
    union = sizes[queries][:, None] + sizes[members][None, :] - both
    both, union = both.astype(np.int64), union.astype(np.int64)
    near = (den * both >= num * union) & (comps[queries][:, None] != comps[members][None, :])
    return [(queries[p], members[q]) for p, q in (np.nonzero(near), np.nonzero(100 * both >= LOOSE * union))]


def _linked(num: int, den: int):
    def step(table: pa.Table) -> pa.RecordBatch | None:
        meet = table.column("meet").to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], meet[1:] != meet[:-1])))
        ends = np.concatenate((heads[1:], [len(meet)]))
        f, comp = table.column("f").to_numpy(), table.column("comp").to_numpy()
        query = table.column("query").to_numpy(zero_copy_only=False)
        lists = table.column("tokens").combine_chunks()
        cut, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(heads, ends, strict=True):
            tokens = [values[cut[i] : cut[i + 1]] for i in range(a, b)]
            members = np.flatnonzero(~query[a:b])
            queries = np.flatnonzero(query[a:b])
            if not len(queries):
                queries = members
            else:
                union = np.unique(np.concatenate([tokens[i] for i in members])) if len(members) else np.zeros(0, np.uint64)
                bound = [np.isin(tokens[i], union, assume_unique=True).sum() >= _least(len(tokens[i]), num, den) for i in queries]
                queries = queries[np.array(bound, bool)]
            if not len(queries) or not len(members) or b - a < 2:
                continue
            for strict, (p, q) in zip((True, False), _compare(tokens, queries, members, comp[a:b], num, den), strict=True):
                root = local_roots(b - a, p, q)
                hit = np.flatnonzero(root != np.arange(b - a))
                found.append((f[a:b][hit], f[a:b][root[hit]], np.full(len(hit), strict)))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "strict"])

    return step


def _grown(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known (f, comp) after the edges (a, b) between sets have joined components."""
    comp = known.select("f", "comp")
    between = edges.join(comp.select(F.col("f").alias("a"), F.col("comp").alias("x")), "a").join(comp.select(F.col("f").alias("b"), F.col("comp").alias("y")), "b")
    roots = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return known.join(roots, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "comp")).drop("node", "root")


def _own_blocks(sets: DataFrame) -> DataFrame:
    """The sets (f, tokens, key, size: sets of that key) in the blocks of their group."""
    chunks = F.expr(f"(size + {CHUNK - 1}) DIV {CHUNK}")
    own = F.pmod(F.xxhash64("f", F.lit("block")), chunks)
    everywhere = (chunks > 1) & (F.pmod(F.xxhash64("f", F.lit("pivot")), F.expr(f"greatest(1, size DIV {PIVOTS})")) == 0)
    chunk = F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(own)))
    dealt = sets.where("size > 1").select("f", F.col("f").alias("comp"), "key", chunk.alias("chunk"), "tokens")
    return dealt.select("f", "comp", F.xxhash64("key", "chunk").alias("meet"), F.lit(False).alias("query"), "tokens")


def _opened(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links between what meets in a block: a, b, strict (or of one family)."""
    return over_groups(rows.repartition("meet"), "meet", _linked(num, den), "a long, b long, strict boolean", 2_000)


def _matrix_round(known: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Queries of sets against the blocks that hold one of their rarest tokens from another component, and members of a
    size and with enough tokens behind that one to share what a link needs."""
    sizes = known.groupBy("kin").agg(F.count("*").alias("size"))
    block = F.xxhash64("kin", F.pmod(F.xxhash64("f", F.lit("block")), F.expr(f"(size + {CHUNK - 1}) DIV {CHUNK}")))
    placed = materialize(known.join(sizes, "kin").select("f", "comp", "n", "m", "probe", block.alias("block")), "blocks")
    # left: tokens of the set from this one on, which bound what it can share if this is the first that it shares
    tokens = placed.select("f", "comp", "block", "n", "m", F.posexplode("probe").alias("at", "t")).withColumn("left", F.col("m") - F.col("at")).drop("m", "at")
    least_, most_, left_ = F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("left").alias("most_left")
    matrix_ = materialize(tokens.groupBy("t", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), least_, most_, left_), "matrix")
    shared = matrix_.groupBy("t").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("t")
    matrix = matrix_.join(shared, "t", "left_semi").withColumnRenamed("block", "asked")
    # the smallest partner that the block can hold, and what must be shared with it
    small = f"greatest(least_n, (n * {num} + {den - 1}) DIV {den})"
    need = f"(((n + {small}) * {num} + {num + den - 1}) DIV {num + den})"
    fits = f"{small} <= most_n AND least_n * {num} <= n * {den} AND left >= {need} AND most_left >= {need}"
    asked = tokens.join(matrix, "t").where(f"block <= asked AND (low <> comp OR high <> comp) AND {fits}")
    asked = asked.select("f", "comp", F.col("asked").alias("block")).distinct()
    asked = materialize(asked, "asked")
    share = asked.groupBy("block").agg(F.expr(f"(count(*) + {CHUNK - 1}) DIV {CHUNK}").alias("shares"))
    query = asked.join(share, "block").select("f", "comp", F.xxhash64("block", F.pmod(F.xxhash64("f", F.lit("share")), "shares")).alias("meet"), F.lit(True).alias("query"))
    member = placed.join(share, "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    member = member.select("f", "comp", F.xxhash64("block", "share").alias("meet"), F.lit(False).alias("query"))
    edges = materialize(_opened(query.union(member).join(sets, "f"), num, den), "links")
    release(placed, matrix_, asked)
    return edges


def _text_hash(text="text"):
    return F.xxhash64(text)


def _id(doc_id="doc_id"):
    """doc_id as a text that null ids have too."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def _measured(k: int):
    def step(batches):
        for batch in batches:
            n, f, has = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for r, tokens in _sets(batch, k):
                n[r], f[r], has[r] = len(tokens), _name(tokens), True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(n), pa.array(f, mask=~has)], ["doc_id", "hash", "n_shingles", "f"])

    return step


def _first_tokens(k: int, num: int, den: int, often: np.ndarray):
    """The first tokens of each set: dealt by the token, and the set beside it; those in `often` the other way round."""

    def step(batches):
        seen: set[int] = set()
        for batch in batches:
            out_t, out_f = [], []
            for _, tokens in _sets(batch, k):
                f = _name(tokens)
                if f in seen:  # a map-side combine
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(f)
                t = tokens[: _prefix(len(tokens), num, den)]
                out_t.append(t)
                out_f.append(np.full(len(t), f))
            if out_t:
                t, f = np.concatenate(out_t).view(np.int64), np.concatenate(out_f)
                known = np.isin(t, often) if len(often) else np.zeros(len(t), bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(known, f, t)), pa.array(np.where(known, t, f)), pa.array(known)], ["d", "x", "often"])

    return step


def _shared(table: pa.Table) -> pa.RecordBatch | None:
    """Of whole groups of first tokens, the distinct (f, t) whose token several sets have, and whether it is in `often`."""
    d, x, often = (table.column(c).to_numpy() for c in ("d", "x", "often"))
    order = np.lexsort((x, d, often))
    d, x, often = d[order], x[order], often[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (often[1:] != often[:-1])))
    d, x, often = d[new], x[new], often[new]
    same = (d[1:] == d[:-1]) & ~often[1:] & ~often[:-1]
    keep = often | np.concatenate(([False], same)) | np.concatenate((same, [False]))
    if not keep.any():
        return None
    f, t = np.where(often, d, x), np.where(often, x, d)
    return pa.RecordBatch.from_arrays([pa.array(f[keep]), pa.array(t[keep]), pa.array(often[keep])], ["f", "t", "often"])


def _whole_sets(k: int):
    def step(batches):
        seen: set[int] = set()  # repeated rows stand together
        for batch in batches:
            rows, cuts, out = [], [0], []
            f = batch.column("f").to_numpy()
            for r, tokens in _sets(batch, k):
                if f[r] in seen:
                    continue
                seen.add(int(f[r]))
                rows.append(r)
                cuts.append(cuts[-1] + len(tokens))
                out.append(tokens.view(np.int64))
            if rows:
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("f", "key", "size")), lists], ["f", "key", "size", "tokens"])

    return step


def _joined(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and set f of every row; and for each set (of) its first row and that of its component.

    A row is known by (none, doc_id, hash): whether its id is null, its id, and the hash of its text. The first has the
    least id that isn't null, if there is one.
    """
    base = docs.select("doc_id", "text", _text_hash().alias("hash"))
    rows = materialize(base.mapInArrow(_measured(k), "doc_id long, hash long, n_shingles long, f long"), "measured")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    each = materialize(rows.where("f IS NOT NULL").groupBy("f").agg(F.max("n_shingles").alias("n"), F.min(row).alias("row")), "sets")

    # 1: first tokens in hash order
    schema = "d long, x long, often boolean"
    part = min(1 << 20, (SAMPLED << 20) // max(1, rows.count()))
    sampled = base.where(F.pmod("hash", F.lit(1 << 20)) < part).select("text").mapInArrow(_first_tokens(k, num, den, np.zeros(0, np.int64)), schema)
    often = sampled.groupBy("d").agg(F.count_distinct("x").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "d").limit(MOST_OFTEN)
    often = np.sort(np.array([r["d"] for r in often.select("d").collect()], np.int64))  # at most MOST_OFTEN
    emitted = base.select("text").mapInArrow(_first_tokens(k, num, den, often), schema)
    pairs = materialize(over_groups(emitted.repartition("d"), "d", _shared, "f long, t long, often boolean", 200_000), "pairs")
    smallest = F.expr(f"(n * {num} + {den - 1}) DIV {den}")  # the smallest partner
    slack = F.expr(f"small - (small * {num} + {den - 1}) DIV {den}")
    held = pairs.groupBy("f").agg(F.count("*").alias("held"), F.min("t").alias("key"))
    left = held.join(each, "f").withColumn("small", smallest).withColumn("least", F.floor(slack / 2) + 1).where("held >= least")
    left = materialize(left.select("f", "n", "row", "key", "least"), "left")

    # 2: groups of sets with the same least shared token
    sizes = left.groupBy("key").agg(F.count("*").alias("size"))
    wanted = left.join(sizes, "key").select(_id("row.doc_id").alias("id"), F.col("row.hash").alias("hash"), F.col("row.none").alias("none"), "f", "key", "size")
    texts = base.select(_id().alias("id"), "hash", F.col("doc_id").isNull().alias("none"), "text").join(wanted, ["id", "hash", "none"])
    texts = texts.select("f", "key", "size", "text").mapInArrow(_whole_sets(k), "f long, key long, size long, tokens array<long>")
    sets = materialize(texts, "tokens")

    # 3: every block is opened for its own members
    edges = materialize(_opened(_own_blocks(sets), num, den), "links")
    known = left.select("f", F.col("f").alias("comp"), "least")
    roots = components(edges.where("strict").select("a", "b")).select(F.col("node").alias("f"), "root")
    known = materialize(known.join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("comp"), "least"), "known")
    across = pairs.join(known, "f").groupBy("t", "often").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    across = materialize(across.where("low <> high").select("t", "often"), "across")
    # rows of tokens in `often`, of which there are at most MOST_OFTEN, stay where they are
    held = pairs.where("often").join(F.broadcast(across.where("often").select("t")), "t", "left_semi")
    held = held.union(pairs.where("NOT often").join(across.where("NOT often").select("t"), "t", "left_semi"))
    rest = held.groupBy("f").agg(F.count("*").alias("held")).join(known, "f").where("held >= least")
    rest = materialize(rest.select("f", "comp"), "rest")
    families = materialize(sets.select("f", "tokens").join(rest, "f"), "families")

    # 4: all tokens of the sets left; those of one component don't count
    tokens = families.select("f", "comp", F.explode("tokens").alias("t"))
    counts = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("t", "df")
    shared = tokens.join(counts, "t").groupBy("f").agg(F.sort_array(F.collect_set(F.struct("df", "t"))).alias("shared"))
    need = F.expr(f"(n * {num} + {den - 1}) DIV {den}")
    # rarest first: with all but need - 1 of its shared tokens a set meets every partner
    probe = F.slice("shared", F.lit(1), (F.size("shared") - need + 1).cast("int"))["t"]
    kin = components(edges.select("a", "b")).select(F.col("node").alias("f"), F.col("root").alias("kin"))
    probed = shared.join(left.select("f", "n"), "f").where(F.size("shared") >= need).select("f", F.col("n").cast("long").alias("n"), F.size("shared").alias("m"), probe.alias("probe"))
    probed = probed.join(rest, "f").join(kin, "f", "left").select("f", "comp", "n", "m", "probe", F.coalesce("kin", "f").alias("kin"))
    probed = materialize(probed, "probed")
    more = _matrix_round(probed, families.select("f", "tokens"), num, den)
    known = _grown(known.select("f", "comp"), more.where("strict"))
    of_sets = known.join(each.select("f", "row"), "f")
    least = of_sets.groupBy("comp").agg(F.min("row").alias("first"))
    named = of_sets.select("f", "comp").join(least, "comp").select(F.col("f").alias("f_"), "first")
    named = each.join(named, F.col("f") == F.col("f_"), "left").select(F.col("f").alias("of"), "row", F.coalesce("first", "row").alias("first"))
    named = materialize(named, "components")
    release(each, pairs, left, sets, edges, across, rest, families, probed, more)
    return rows, named


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, named = _joined(docs, k, num, den)
    named = named.select("of", F.col("first.doc_id").alias("component"))
    return rows.join(named, F.col("f") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, once: the one whose doc_id names it, or if no id does, the one with
    the least text hash. Of texts without words, which link with nothing, one of each doc_id stays, and each without.
    Of rows equal in id and text the one with the least hash of all its columns stays."""
    rows, named = _joined(docs, k, num, den)
    one = named.where("row <=> first").select("row.none", _id("row.doc_id").alias("id"), F.col("row.hash").alias("hash"))
    blank = rows.where("f IS NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("hash").alias("hash"))
    one = materialize(one.union(blank.select(F.lit(False), _id(), "hash")), "kept")
    packed = docs.select(F.struct("*").alias("row"))  # whatever other columns are called, they don't clash
    keys = ["none", "id", "hash"]
    packed = packed.select("row", F.col("row.doc_id").isNull().alias("none"), _id("row.doc_id").alias("id"), _text_hash("row.text").alias("hash"))
    first = packed.join(one, keys, "left_semi").groupBy(*keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    worded = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    return first.select("row").union(packed.where(F.col("none") & ~worded).select("row")).select("row.*")
