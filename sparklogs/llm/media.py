"""Media columns: ISO base media containers in a binary column, written and read back box by box.

`encode` stores each text's bytes as 8-bit PCM ('ipcm' with a 'pcmC' box) in ftyp / moov / mdat; `describe` walks the
nested boxes of any such column, decodes the sample tables (stts, stsc, stsz, stco or co64, stss) of every track and gives
its codec, duration and the byte range of every sync sample. Payload bytes are only sliced, never decoded.

Defined cases: a null text is stored as one sample of spaces; null or broken media give an `error` and no index;
repeated rows are rows each; equal texts give equal containers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of one sample, samples of one chunk, distance of sync samples, bytes a second.
SAMPLE, PER_CHUNK, SYNC, RATE = 192, 16, 8, 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes) -> bytes:
    """payload (a positive multiple of SAMPLE bytes) as an ISO base media file of one PCM track."""
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if chunks > 1 else []
    if chunks == 1 or last != PER_CHUNK:
        runs.append((chunks, last, 1))
    entry = _box(
        b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16), _full(b"pcmC", bytes([1, 8]))
    )
    sync = np.arange(1, n + 1, SYNC, dtype=">u4")

    def head(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * SAMPLE)
        wide = bool(offsets[-1] >= 1 << 32)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        )
        size = len(payload)
        moov = _box(
            b"moov",
            _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, size), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), version=1),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, size), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">QQIQ", 0, 0, RATE, size), struct.pack(">HH", 0x55C4, 0), version=1),
                    _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
                ),
            ),
        )
        return _box(b"ftyp", b"iso6", struct.pack(">I", 0), b"iso6", b"mp41") + moov

    start = len(head(0)) + 8
    return head(start) + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """(path, start, end) of each box's body, parents before children."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise ValueError(f"cut size at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has {size} bytes of {end - start}")
        yield path + b"/" + kind, body, start + size
        if kind in _NESTED:
            yield from boxes(data, body, start + size, path + b"/" + kind)
        start += size


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + skip)
    width = int(kind[-1]) * columns
    if at + skip + 4 + n * width > end:
        raise ValueError("table runs past its box")
    return np.frombuffer(data, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def _track(data: memoryview, at: dict[bytes, tuple[int, int]]) -> dict:
    """What the boxes of one track say: their last names and where their bodies are."""
    if missing := {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - at.keys():
        raise ValueError(f"no {sorted(missing)[0].decode()} box")
    start, _ = at[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, start + 20) if data[start] == 1 else struct.unpack_from(">II", data, start + 12)
    start, end = at[b"stsd"]
    codec = bytes(data[start + 12 : start + 16]).decode("latin1")
    start, end = at[b"stsz"]
    (size,) = struct.unpack_from(">I", data, start + 4)
    (n,) = struct.unpack_from(">I", data, start + 8)
    if n * size > len(data):
        raise ValueError(f"{n} samples of {size} bytes don't fit the file")
    sizes = np.full(n, size, np.int64) if size else _table(data, start, end, 1, skip=8)[:, 0]
    if b"stco" not in at and b"co64" not in at:
        raise ValueError("no stco or co64 box")
    offsets = _table(data, *at[b"stco"], 1)[:, 0] if b"stco" in at else _table(data, *at[b"co64"], 1, ">u8")[:, 0]
    runs = _table(data, *at[b"stsc"], 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(offsets)):
        raise ValueError("runs of chunks don't ascend from the first chunk to one of the last")
    per = np.zeros(len(offsets), np.int64)
    for i, (first, count, _) in enumerate(runs):
        per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else None] = count
    if per.sum() != n:
        raise ValueError(f"{per.sum()} samples in chunks, {n} in the size table")
    ends = np.cumsum(sizes)
    edges = np.concatenate(([0], ends))  # bytes before each sample
    chunk_of = np.repeat(np.arange(len(offsets)), per)
    first = np.concatenate(([0], np.cumsum(per)))  # each chunk's first sample, and the end
    begin = offsets[chunk_of] + (ends - sizes - edges[first[chunk_of]])
    sync = _table(data, *at[b"stss"], 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError(f"a keyframe is none of the {n} samples")
    whole = edges[first[1:]] - edges[first[:-1]]
    if len(begin) and int((begin + sizes).max()) > len(data):
        raise ValueError("samples lie past the file")
    return {
        "handler": bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin1") if b"hdlr" in at else "",
        "codec": codec, "timescale": timescale, "duration": duration, "ticks": int(_table(data, *at[b"stts"], 2).prod(axis=1).sum()), "samples": n,
        "keyframes": np.stack([begin[sync], begin[sync] + sizes[sync]], 1), "ranges": list(zip(offsets.tolist(), (offsets + whole).tolist(), strict=True)),
    }


def index(media: bytes) -> list[dict]:
    """For each track: handler, codec, timescale, duration, samples, keyframes [(start, end)] and ranges [(start, end)] of the chunks."""
    data = memoryview(media)
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in boxes(data):
        if path == b"/moov/trak":
            tracks.append({})
        elif path.startswith(b"/moov/trak/"):  # boxes come after the box that they are in
            tracks[-1].setdefault(path.rsplit(b"/", 1)[1], (start, end))
    if not tracks:
        raise ValueError("no trak box")
    return [_track(data, at) for at in tracks]


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up with spaces, in a container of its own."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [container(t + b" " * (-len(t) % SAMPLE or (0 if t else SAMPLE))) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_SPANS = "array<struct<start: long, end: long>>"
INDEX_SCHEMA = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    f"tracks array<struct<handler: string, codec: string, seconds: double, samples: long, keyframes: {_SPANS}>>, feature string, error string"
)

INDEX_NAMES = "doc_id n_bytes media_bytes media_sha256 payload_bytes payload_sha256 tail_crc32 tracks feature error".split()
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACK_TYPE = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", _SPAN_TYPE)]))


def _described(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7 + ("no media",)
    digest = hashlib.sha256(media).hexdigest()
    try:
        tracks = index(media)
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return (len(media), digest) + (None,) * 5 + (str(e) or "broken",)
    payload = b"".join(media[a:b] for a, b in sorted(r for x in tracks for r in x["ranges"]))
    shown, features = [], []
    for x in tracks:
        keys = x["keyframes"].tolist()
        seconds = x["duration"] / x["timescale"] if x["timescale"] else None
        shown.append({"handler": x["handler"], "codec": x["codec"], "seconds": seconds, "samples": x["samples"], "keyframes": [{"start": a, "end": b} for a, b in keys]})
        features.append(f"{x['codec']};{x['timescale']};{x['duration']};{x['samples']};" + ",".join(f"{a}-{b}" for a, b in keys))
    return len(media), digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), shown, "|".join(features), None


def describe(media: DataFrame) -> DataFrame:
    """The index of each container: codec, duration and keyframe byte ranges of every track, and digests of what was read back."""
    names = INDEX_NAMES

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), _TRACK_TYPE, pa.string(), pa.string()]
        for batch in batches:
            rows = [_described(m) for m in batch.column("media").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, INDEX_SCHEMA)
