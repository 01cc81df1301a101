"""Toxicity: a weighted finite-state grammar over clauses.

Words are mapped to the symbols insult, threat, target, negation, report and other. Five transducers read the symbols
of a clause, each from the left and from the right: target, negation and report keep the context that they open, insult
and threat the match that they wait to join. The composition of those of one direction is one table over the tuples of
their states; a match emits its word's weight into the context that the two tables' states at its place give:

* an insult: negated, reported, targeted (a target within TARGET_SPAN words on either side), joined (with another
  insult or threat in the clause) or else lone;
* a threat: negated, reported or threat, if a target stands within the span on either side or an insult joins it; a
  threat word alone is none.

A document's score is a logistic function of its matched clauses' weights by context, of which negated, reported and
lone ones have gains of their own. Of lone matches the heaviest doesn't count: one isolated word scores nothing.

Learned from labels, from a bounded sample of labelled rows: words and word beginnings of 4 to 9 bytes that tell toxic
texts (those that a likelihood-ratio test over all candidates keeps; such a word is an insult, even if it is listed as a
target, negation or report), the weights of the words listed below, and the gains. Fixed: short lists of insults and threats, as a start where there are few labels, and of pronouns, negations
and speech verbs.

Defined cases: a null, empty or wordless text has no clause and gets the score of that; without labels only the listed
words count, by the weight START; repeated rows are scored each; an empty table gives no rows; other columns are
ignored by `score` and kept by `reject`. Whole texts are read, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, materialize, mix, release, slices, string_parts

#: Labelled rows that are learned from, at most; they bound the lexicon too.
SAMPLE_ROWS = 20_000
PREFIXES = (4, 5, 6, 7, 8, 9)
SHINGLE = 4
THRESHOLD = 0.3
#: A candidate is kept if its likelihood ratio statistic exceeds BAR x log(candidates), and its log odds ODDS.
BAR, ODDS = 1.2, 2.5
#: Weight of a listed word before any label is seen, and how many texts that counts for.
START, START_TEXTS = 3.0, 3.0

# Common insults and threats, and closed word classes, of the four languages.
INSULTS = (
    "idiot moron scum trash worthless clown disgusting stupid loser pathetic imbecile pig filth coward bastard vermin "
    "dummkopf trottel abschaum widerlich versager feigling schwein drecksack imbécile crétin abruti ordure minable connard lâche "
    "imbécil estúpido basura asqueroso cobarde cerdo inútil escoria"
).split()
THREATS = (
    "kill hurt destroy beat burn stab shoot strangle die töten umbringen schlagen verletzen vernichten erschießen tuer frapper "
    "détruire brûler blesser matar golpear destruir quemar herir"
).split()
TARGETS = "you your he him she her they them du dich dir ihr ihn sie tu toi te vous il elle ils tú usted él ella ellos".split()
NEGATIONS = "not no never isn don doesn nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called wrote quoted claims sagte sagt schrieb dit écrit appelle dijo dice escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CONTEXTS = ("lone", "joined", "targeted", "negated", "reported", "threat")
LONE, JOINED, TARGETED, NEGATED, REPORTED, THREATENED = range(6)
#: Gains before any label is seen: of the contexts, of the logarithm of the clauses (any sign), and the bias.
PRIOR = np.array([1.2, 1.5, 1.6, 0.4, 0.7, 1.6, 0.0, -3.0])
#: Words after a negation that it governs, and words on either side of a target that it governs.
NEGATION_SPAN, TARGET_SPAN = 3, 4


def _machine(symbol: int, span: int | None) -> np.ndarray:
    """next[state, symbol] of a machine that `symbol` starts: a countdown of span words; span None: to the clause's end."""
    states = 2 if span is None else span + 1
    table = np.zeros((states, 6), np.int64)
    for s in range(states):
        table[s] = s if span is None else max(0, s - 1)
        table[s, symbol] = states - 1
    return table


def _product(*machines: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The composition of machines that read the same symbols: one table over the tuples of their states."""
    shapes = [len(m) for m in machines]
    states = [tuple(x) for x in np.ndindex(*shapes)]
    number = {s: i for i, s in enumerate(states)}
    table = np.array([[number[tuple(int(m[q, a]) for m, q in zip(machines, s, strict=True))] for a in range(6)] for s in states])
    return table, states


_MACHINES = [_machine(INSULT, None), _machine(THREAT, None), _machine(TARGET, TARGET_SPAN), _machine(REPORT, None)]
_LEFT, _LEFT_STATES = _product(*_MACHINES, _machine(NEGATION, NEGATION_SPAN))
_RIGHT, _RIGHT_STATES = _product(*_MACHINES)


def _context(symbol: int, left: tuple[int, ...], right: tuple[int, ...]) -> int:
    """The context of a match between two states, -1: none."""
    insult, threat, target, report = (bool(x or y) for x, y in zip(left, right, strict=False))
    if symbol == THREAT and not target and not insult:
        return -1
    if left[4]:
        return NEGATED
    if report:
        return REPORTED
    if symbol == THREAT:
        return THREATENED
    return TARGETED if target else JOINED if insult or threat else LONE


#: context[symbol, left state, right state] of the whole composition.
_CONTEXT = np.array([[[_context(a, x, y) for y in _RIGHT_STATES] for x in _LEFT_STATES] for a in (INSULT, THREAT)])


def clause(symbols, weights) -> tuple[np.ndarray, float]:
    """The weights that the composed transducer emits over one clause, by context, and the heaviest lone one."""
    out, most = np.zeros(len(CONTEXTS)), 0.0
    right, state = [], 0
    for a in reversed(symbols):
        right.append(state)
        state = _RIGHT[state, a]
    state = 0
    for a, w, after in zip(symbols, weights, reversed(right), strict=True):
        if a in (INSULT, THREAT) and (c := _CONTEXT[a - INSULT, state, after]) >= 0:
            out[c] += w
            most = max(most, w) if c == LONE else most
        state = _LEFT[state, a]
    return out, most


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;\n|"]] = True


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with all but letters made spaces, offsets, and the clause number at each byte.

    Not letters either: U+0080 to U+00BF but for ª, µ and º, and general and ideographic punctuation (U+2000 to U+206F,
    U+3000 to U+303F); an ellipsis ends a clause.
    """
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    letter, end = _LETTER[raw], _BREAK[raw]
    if len(raw) and raw.max() >= 0xC2:
        two = np.flatnonzero(raw[:-1] == 0xC2)
        two = two[~np.isin(raw[two + 1], (0xAA, 0xB5, 0xBA))]
        letter[two] = letter[two + 1] = False
        three = np.flatnonzero(((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81) & (raw[2:] < 0xB0))) | ((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80)))
        letter[three] = letter[three + 1] = letter[three + 2] = False
        end[three] |= (raw[three] == 0xE2) & (raw[three + 1] == 0x80) & (raw[three + 2] == 0xA6)
    return np.where(letter, raw, np.uint8(32)), offsets, np.cumsum(end)


def _features(words: Words, total: np.ndarray | None = None) -> list[np.ndarray]:
    """Per word: the hash of the word, and of its first 4 to 9 bytes (0 if it is not longer than that)."""
    length = words.ends - words.starts
    out = [words.hashes]
    for p in PREFIXES:
        h = np.full(len(length), p, np.uint64)
        long = np.flatnonzero(length > p)
        at = words.starts[long]
        part = np.full(len(long), p, np.uint64)
        for j in range(p):
            part = part * np.uint64(1_099_511_628_211) + words.data[at + j]
        h[:] = 0
        h[long] = mix(part + np.uint64(p << 40)) | np.uint64(1)
        out.append(h)
    return out


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)])).hashes[0])


@dataclass
class Model:
    """keys (sorted feature hashes), weights, and gains as in PRIOR."""

    keys: np.ndarray
    weights: np.ndarray
    gains: np.ndarray

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)


def _closed() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted({word_hash(w): s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}.items())
    return np.array([k for k, _ in pairs], np.uint64), np.array([s for _, s in pairs])


def contexts(texts: list[bytes], model: Model) -> np.ndarray:
    """For each text the logarithm of 1 + the weights of its clauses by context, and that of 1 + its clauses."""
    closed, kinds = _closed()
    out = np.zeros((len(texts), len(CONTEXTS) + 1))
    heaviest = np.zeros(len(texts))
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for i, j in slices(offsets):
        raw, at, clauses = _letters(texts[i:j])
        words = Words(raw, at)
        if not len(words.starts):
            continue
        weight = np.zeros(len(words.starts))
        for h in _features(words):
            weight = np.maximum(weight, model.lookup(h))
        place = np.minimum(np.searchsorted(closed, words.hashes), len(closed) - 1)
        symbols = np.where(closed[place] == words.hashes, kinds[place], OTHER)
        symbols = np.where((weight > 0) & (symbols != THREAT), INSULT, symbols)
        row, name = words.rows(), clauses[words.starts]
        edges = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1]), [True])))
        which = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        out[i:j, -1] += np.bincount(row[edges[:-1]], minlength=j - i)
        for c in np.unique(which[weight > 0]):  # clauses with a match only
            a, b = edges[c], edges[c + 1]
            r = i + row[a]
            emitted, most = clause(symbols[a:b].tolist(), weight[a:b].tolist())
            out[r, :-1] += emitted
            heaviest[r] = max(heaviest[r], most)
    out[:, LONE] -= heaviest
    return np.log1p(np.maximum(out, 0))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """text and label (0/1) of at most `most` labelled rows that aren't held out, the first by hash of the id."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(column).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    rows = materialize(rows, "labels").withColumnRenamed("doc_id", "id_")
    # the sample's size is bounded by `most`
    return docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """The lexicon and the gains from at most `most` labelled rows, copies among them counted once."""
    rows = materialize(sample(docs, labels, column, most), "toxic-sample")

    def sketch(batches):
        for batch in batches:
            least = []
            data, offsets = string_parts(batch.column("text"))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = words.grams(SHINGLE)
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    own = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else words.hashes[a:b]
                    least.append(int(own.min() >> np.uint64(1)) if b > a else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "label")), pa.array(least, pa.int64())], ["doc_id", "text", "label", "sketch"])

    # near copies of one document say the same thing: of those with the same least shingle hash and label one counts
    sketched = rows.select("doc_id", "text", "label").mapInArrow(sketch, "doc_id long, text string, label int, sketch long")
    one = sketched.groupBy("sketch", "label").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    distinct = materialize(one.select("text", "label"), "toxic-distinct")
    release(rows)
    rows = distinct

    def count(batches):
        for batch in batches:
            for h, pos, neg in counted(_lowered(batch.column("text")), batch.column("label").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(pos), pa.array(neg)], ["h", "pos", "neg"])

    all_pos, all_n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    all_neg = all_n - all_pos
    start = _listed()
    if not all_pos or not all_neg:
        return Model(start, np.full(len(start), START), PRIOR.copy())
    seen = rows.select("text", "label").mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = materialize(seen.where("pos + neg >= 2"), "toxic-features")
    share = all_pos / all_n
    n = F.col("pos") + F.col("neg")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / (all_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (all_neg + 1.0))
    ratio = 2 * (part(F.col("pos"), F.lit(share)) + part(F.col("neg"), F.lit(1 - share)))
    listed = F.col("h").isin([int(x) for x in start.view(np.int64)])
    bar = BAR * np.log(max(2, seen.count()))
    kept = seen.withColumn("odds", odds).withColumn("listed", listed).where(listed | ((odds > ODDS) & (ratio > bar)))
    kept = kept.select("h", "pos", "neg", "odds", "listed").orderBy("h").toPandas()  # a part of the sample's words
    release(seen)
    entries = dict.fromkeys(start.tolist(), START)
    for h, k, odd, is_listed in zip(kept["h"].to_numpy(np.int64).view(np.uint64).tolist(), kept["pos"] + kept["neg"], kept["odds"], kept["listed"], strict=True):
        entries[h] = max(0.0, (START * START_TEXTS + odd * k) / (START_TEXTS + k)) if is_listed else odd
    keys = np.array(sorted(entries), np.uint64)
    model = Model(keys, np.array([entries[k] for k in keys.tolist()]), PRIOR.copy())
    names = [*CONTEXTS, "clauses"]

    def read_clauses(batches):
        for batch in batches:
            x = contexts(_lowered(batch.column("text")), model)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(len(names))], batch.column("label")], [*names, "label"])

    schema = ", ".join(f"{c} double" for c in names) + ", label int"
    # as many rows of numbers as the sample has; rounding and a count per kind keep them few
    kinds = rows.select("text", "label").mapInArrow(read_clauses, schema)
    kinds = kinds.groupBy(*[F.round(c, 1).alias(c) for c in names], "label").count().orderBy(*names, "label").toPandas()
    model.gains = _gains(kinds[names].to_numpy(float), kinds["label"].to_numpy(float), kinds["count"].to_numpy(float))
    release(rows)
    return model


def _listed() -> np.ndarray:
    return np.array(sorted(word_hash(w) for w in (*INSULTS, *THREATS)), np.uint64)


def counted(texts: list[bytes], label: np.ndarray):
    """(feature, texts of label 1 that have it, texts of label 0) of slices of the texts."""
    for i, j in slices(np.concatenate(([0], np.cumsum([len(t) for t in texts])))):
        raw, at, _ = _letters(texts[i:j])
        words = Words(raw, at)
        hashes = np.concatenate(_features(words))
        row = np.tile(words.rows(), 1 + len(PREFIXES))
        keep = hashes != 0
        pair = np.unique(np.stack([hashes[keep].view(np.int64), row[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        h, back = np.unique(pair[:, 0], return_inverse=True)
        toxic = label[i:j][pair[:, 1]]
        yield h, np.bincount(back, toxic, len(h)).astype(np.int64), np.bincount(back, 1 - toxic, len(h)).astype(np.int64)


def _gains(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 2.0) -> np.ndarray:
    """Logistic regression, with non-negative gains of the contexts, pulled to PRIOR; Newton steps on the penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    g = PRIOR.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ g, -30, 30)))
        slope = x.T @ (n * (p - y)) + pull * (g - PRIOR)
        curve = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + pull * np.eye(len(g))
        step = np.linalg.solve(curve, slope)
        g = g - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        g[: len(CONTEXTS)] = np.maximum(g[: len(CONTEXTS)], 0)
    return g


def probability(texts: list[bytes], model: Model) -> np.ndarray:
    x = contexts(texts, model)
    return 1 / (1 + np.exp(-np.clip(x @ model.gains[:-1] + model.gains[-1], -30, 30)))


def score_column(model: Model):
    """A column expression of the score of a text; the model, a part of the sample's words, goes to the tasks with it."""

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        parts = [text[i : i + 500] for i in range(0, len(text), 500)]
        return pd.Series(np.concatenate([probability([(t or "").lower().encode() for t in part], model) for part in parts] or [np.zeros(0)]))

    return toxicity


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", held_out().alias("held_out"), score_column(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that score THRESHOLD or more."""
    return docs.where(score_column(model)("text") < THRESHOLD)
