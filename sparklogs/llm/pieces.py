"""Sampled SentencePiece encoding: forward filtering, backward sampling over the piece lattice; lossless decoding.

A text's lattice has an arc for every piece of the vocabulary that matches at a place, and byte arcs where a
character has no piece. Forward filtering sums the weights of all ways to each place; backward sampling draws the
last piece by those sums, then the one before it, so that a whole segmentation is drawn by its exact probability.
Pieces never cross from other characters into white space or over a line feed, so the lattice of a text is a chain
of the lattices of its units (white space before, then characters), which are filtered once and then looked up.
Random numbers are a hash of seed, row key, unit and step: the same row gives the same segmentation anywhere.

The vocabulary is a public one whose path is a parameter; its ranks give the weight of a piece by Zipf's law,
1 / (rank + 1) to the power of `sharpness`. Nothing is trained.

Defined cases: a null text has null ids and 0 pieces; an empty text is the one piece of the leading space; a null key
is key 0; repeated rows are equal; an empty table gives no rows; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, slices, string_parts

SPACE, MARK = "▁", "\udc81"  # MARK stands for a literal U+2581 of the text, which no piece may take
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS, SEED = 0.7, 17
#: Units that a task keeps filtered: arcs, at most; beyond that it begins anew.
MOST_ARCS = 3_000_000
#: Units that are filtered at once.
UNITS = 2_000
_UNIT = re.compile("▁*[^▁\n]+|▁+|\n")


@dataclass
class Vocabulary:
    """pieces by id, the logarithm of each weight, and the ids of the 256 byte pieces. Bounded by the model."""

    pieces: list[str]
    weights: list[float]
    bytes_: list[int]

    def table(self) -> list[bytes]:
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in enumerate(self.bytes_):
            out[i] = bytes([value])
        return out


def vocabulary(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = len(model)
    pieces = [model.id_to_piece(i) for i in range(n)]
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)]
    rank = {i: r for r, i in enumerate(sorted((i for i in range(n) if plain[i]), key=lambda i: (-model.get_score(i), i)))}
    weights = [-sharpness * math.log(rank[i] + 1.0) if plain[i] else -math.inf for i in range(n)]
    return Vocabulary(pieces, weights, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


_FACTOR = np.uint64(1_099_511_628_211)


class Lattices:
    """Filtered lattices of units. A state is a place in a unit; its incoming arcs have cumulative probabilities."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        known: dict[str, tuple[int, float]] = {}  # every piece, and every beginning of one as piece -1
        for i, (p, w) in enumerate(zip(vocabulary.pieces, vocabulary.weights, strict=True)):
            if w > -math.inf:
                for k in range(1, len(p)):
                    known.setdefault(p[:k], (-1, 0.0))
                known[p] = (i, w)
        self.longest = max(map(len, known))
        hashes = []
        for p in known:
            h = 0
            for c in p:
                h = (h * int(_FACTOR) + ord(c) + 1) % (1 << 64)
            hashes.append(h)
        hashed = mix(np.array(hashes, np.uint64))
        order = np.argsort(hashed)
        self.hashed = hashed[order]
        self.ids = np.array([i for i, _ in known.values()], np.int32)[order]
        self.weights = np.array([w for _, w in known.values()])[order]
        self.bytes_ = np.array(vocabulary.bytes_, np.int32)
        self.clear()

    def clear(self) -> None:
        self.final: dict[str, int] = {}
        #: State 0 is the start of every unit. The arcs into a state stand together, with their cumulative
        #: probabilities as keys, the last one's being 1; arc 0 is never drawn.
        self.states, self.size = 1, 1
        self.keys, self.before, self.piece = np.ones(1 << 16, np.float32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.arc = np.zeros(1 << 16, np.int32)  # the first arc of each state

    def _arcs(self, chars: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first character, length, piece or -1, weight, bytes of a byte arc) of all arcs."""
        found, alive, h = [], np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        single = np.zeros(len(chars), bool)
        for length in range(1, self.longest + 1):
            inside = alive + length <= unit_end[alive]
            alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = h * _FACTOR + chars[alive + length - 1] + np.uint64(1)
            mixed = mix(h)
            at = np.minimum(np.searchsorted(self.hashed, mixed), len(self.hashed) - 1)
            ok = self.hashed[at] == mixed
            alive, h, at = alive[ok], h[ok], at[ok]
            hit = self.ids[at] >= 0
            found.append((alive[hit], np.full(hit.sum(), length), self.ids[at[hit]], self.weights[at[hit]], np.zeros(hit.sum(), np.int64)))
            if length == 1:
                single[alive[hit]] = True
        raw = np.flatnonzero(~single)  # byte arcs, one weight for each byte
        point = chars[raw]
        size = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        found.append((raw, np.ones(len(raw), np.int64), np.full(len(raw), -1, np.int32), -10.0 * size, size))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def add(self, units: list[str]) -> None:
        lengths = np.array([len(u) for u in units])
        ends = np.cumsum(lengths)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(units)), lengths)
        first, length, pid, weight, size = self._arcs(chars, ends[unit])
        # nodes: places 0..n of each unit in a row
        source, target = first + unit[first], first + unit[first] + length
        place = source - (ends - lengths + np.arange(len(units)))[unit[first]] + length
        order = np.lexsort((target, place))
        source, target, place, first, pid, weight, size = (x[order] for x in (source, target, place, first, pid, weight, size))
        alpha, chance = np.zeros(int(ends[-1]) + len(units)), np.empty(len(order))
        cuts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            w, to = alpha[source[a:b]] + weight[a:b], target[a:b]
            heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            counts = np.diff(np.concatenate((heads, [b - a])))
            most = np.maximum.reduceat(w, heads)
            total = most + np.log(np.add.reduceat(np.exp(w - np.repeat(most, counts)), heads))
            alpha[to[heads]] = total
            chance[a:b] = np.exp(w - np.repeat(total, counts))
        order = np.argsort(target, kind="stable")
        source, target, first, pid, size, chance = (x[order] for x in (source, target, first, pid, size, chance))
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        counts = np.diff(np.concatenate((heads, [len(target)])))
        number = np.zeros(len(alpha), np.int64)  # node to state; the first node of each unit stays 0
        number[target[heads]] = self.states + np.arange(len(heads))
        run = np.cumsum(chance)
        share = np.clip(run - np.repeat(run[heads] - chance[heads], counts), 0, 1)
        share[heads + counts - 1] = 1.0
        keys, before, piece = share.astype(np.float32), number[source], pid.copy()
        states = self.states + len(heads)
        more: list[tuple[float, int, int]] = []  # byte arcs of several bytes run through states of their own
        for k in np.flatnonzero(size):
            c = int(chars[first[k]])
            raw = (SPACE if c == ord(MARK) else chr(c)).encode()
            at = before[k]
            for value in raw[:-1]:
                more.append((1.0, int(at), int(self.bytes_[value])))
                at, states = states, states + 1
            before[k], piece[k] = at, self.bytes_[raw[-1]]
        if more:
            extra = list(zip(*more, strict=True))
            keys, before, piece = (np.concatenate((x, y)) for x, y in zip((keys, before, piece), extra, strict=True))
        end = self.size + len(keys)
        for name in ("keys", "before", "piece", "arc"):
            old = getattr(self, name)
            if max(end, states) > len(old):
                new = np.empty(max(end, states, len(old) * 3 // 2), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.arc[self.states : states] = self.size + np.concatenate((heads, np.arange(len(pid), len(keys))))
        self.keys[self.size : end], self.before[self.size : end], self.piece[self.size : end] = keys, before, piece
        self.final.update(zip(units, number[ends + np.arange(len(units))].tolist(), strict=True))
        self.size, self.states = end, states

    def sample(self, texts: list[str], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one segmentation of each text, in a row, and where each text's begin, with the end."""
        if self.size > MOST_ARCS:
            self.clear()
        units = [_UNIT.findall(SPACE + t.replace(SPACE, MARK).replace(" ", SPACE)) for t in texts]
        if new := {u for us in units for u in us}.difference(self.final):
            ordered = sorted(new)
            for i in range(0, len(ordered), UNITS):
                self.add(ordered[i : i + UNITS])
        counts = np.array([len(us) for us in units])
        get = self.final.__getitem__
        state = np.fromiter((get(u) for us in units for u in us), np.int64, int(counts.sum()))
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        seeds = mix(row_keys[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        drawn = []
        active, length, step = np.arange(len(row)), np.zeros(len(row), np.int64), 0
        while len(active):
            u = (mix(seeds[active] + np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.arc[state[active]]
            below = np.flatnonzero(self.keys[arc] <= u)
            while len(below):
                arc[below] += 1
                below = below[self.keys[arc[below]] <= u[below]]
            drawn.append((active, self.piece[arc]))
            length[active] += 1
            state[active] = self.before[arc]
            active = active[state[active] != 0]
            step += 1
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (active, pieces) in enumerate(drawn):
            out[ends[active] - 1 - step] = pieces
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return out, cuts


def decode_ids(ids, table: list[bytes]) -> str:
    """The text that was encoded: the pieces' bytes, without the space that encoding puts first."""
    return b"".join(map(table.__getitem__, ids))[1:].decode()


def keys_of(ids: pa.Array, seed: int) -> np.ndarray:
    return mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1) + mix(np.array([seed], np.uint64)))


def encode(docs: DataFrame, model: Vocabulary, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids, and lossless: whether decoding the ids gives the text again."""

    def run(batches):
        lattices, table = Lattices(model), model.table()
        for batch in batches:
            keys = keys_of(batch.column("doc_id"), seed)
            _, offsets = string_parts(batch.column("text"))
            for i, j in slices(offsets):
                texts = batch.column("text")[i:j].to_pylist()
                ids, cuts = lattices.sample([t or "" for t in texts], keys[i:j])
                flat, null = ids.tolist(), np.array([t is None for t in texts])
                same = [None if t is None else decode_ids(flat[a:b], table) == t for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids), mask=pa.array(null))
                count = pa.array(np.where(null, 0, np.diff(cuts)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], count, lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model: Vocabulary) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches):
        table = model.table()
        for batch in batches:
            texts = [None if x is None else decode_ids(x, table) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
