import hashlib
import re
import struct

import pytest

from sparklogs.llm import media, secrets

PADS = [b"", b"a", b"x" * 191, b"x" * 192, b"x" * 193, bytes(range(256)) * 40, "é\n".encode() * 5000]


@pytest.mark.parametrize("raw", PADS)
def test_container_round_trip(raw):
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    (x,) = media.index(media.container(payload))
    data = media.container(payload)
    assert b"".join(data[a:b] for a, b in x["ranges"]) == payload
    assert (x["codec"], x["duration"], x["ticks"], x["samples"]) == ("ipcm", len(payload), len(payload), len(payload) // 192)
    keys = x["keyframes"]
    assert len(keys) == -(-x["samples"] // media.SYNC) and all(data[a:b] == payload[i * 192 * 8 :][:192] for i, (a, b) in enumerate(keys))


def test_boxes_nest_and_break():
    data = memoryview(media.container(b" " * 384))
    paths = [p for p, _, _ in media.boxes(data)]
    assert paths[0] == b"/ftyp" and paths[-1] == b"/mdat" and b"/moov/trak/mdia/minf/stbl/stsz" in paths
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    assert list(media.boxes(memoryview(wide))) == [(b"/free", 16, 20)]
    assert list(media.boxes(memoryview(struct.pack(">I4s", 0, b"free") + b"ab"))) == [(b"/free", 8, 10)]
    for broken in (b"abc", struct.pack(">I4s", 4, b"free"), struct.pack(">I4s", 99, b"free"), struct.pack(">I4s", 1, b"free")):
        with pytest.raises(ValueError):
            list(media.boxes(memoryview(broken)))


def test_each_track_has_its_own_tables():
    def track(kind, codec, sizes, runs, offsets, wide, sync=None, same=0):
        full, word = media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
        boxes = [
            full(b"stsd", word(1), media._box(codec, bytes(8))), full(b"stts", word(1, len(sizes), 10)),
            full(b"stsc", word(len(runs)), *[word(*r) for r in runs]), full(b"stsz", word(same, len(sizes)), *([] if same else [word(*sizes)])),
            full(b"co64", word(len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)) if wide else full(b"stco", word(len(offsets), *offsets)),
        ]
        boxes += [full(b"stss", word(len(sync), *sync))] if sync else []
        head = [full(b"mdhd", word(0, 0, 100, 10 * len(sizes), 0)), full(b"hdlr", bytes(4), kind, bytes(13))]
        return media._box(b"trak", media._box(b"mdia", *head, media._box(b"minf", media._box(b"stbl", *boxes))))

    def build(first):
        # audio: 5 samples in chunks of 2, 2 and 1; video between them: 4 samples of differing sizes in chunks of 1 and 3
        a = [first, first + 8 + 3, first + 8 + 3 + 8 + 12]
        v = [first + 8, first + 8 + 3 + 8]
        moov = media._box(b"moov", track(b"soun", b"mp4a", [4] * 5, [(1, 2, 1), (3, 1, 1)], a, False, same=4), track(b"vide", b"avc1", [3, 5, 1, 6], [(1, 1, 1), (2, 3, 1)], v, True, [1, 3]))
        return media._box(b"ftyp", b"isom", bytes(4)) + moov

    start = len(build(0)) + 8
    data = build(start) + media._box(b"mdat", bytes(range(35)))
    audio, video = media.index(data)
    rel = lambda spans: [(int(a) - start, int(b) - start) for a, b in spans]
    assert (audio["handler"], audio["codec"], audio["samples"], video["handler"], video["codec"], video["samples"]) == ("soun", "mp4a", 5, "vide", "avc1", 4)
    assert rel(audio["keyframes"]) == [(0, 4), (4, 8), (11, 15), (15, 19), (31, 35)]
    assert rel(video["ranges"]) == [(8, 11), (19, 31)] and rel(video["keyframes"]) == [(8, 11), (24, 25)]
    assert media._described(data)[2:4] == (35, hashlib.sha256(bytes(range(35))).hexdigest())
    assert media._described(data)[6].count("|") == 1 and (audio["ticks"], video["duration"]) == (50, 40)


def test_media_columns(spark, docs):
    frame = docs("some text", None, "", "some text", "é" * 50_000)
    rows = {r.doc_id: r for r in media.describe(media.encode(frame)).collect()}
    for i, t in enumerate(["some text", "", "", "some text", "é" * 50_000]):
        payload = t.encode() + b" " * (-len(t.encode()) % 192 or (0 if t else 192))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert rows[i].error is None and [len(t.keyframes) for t in rows[i].tracks] == [-(-rows[i].tracks[0].samples // media.SYNC)]
    assert rows[0][2:] == rows[3][2:] and rows[1][2:] == rows[2][2:]
    broken = spark.createDataFrame([(1, 1, bytearray(b"junk data")), (2, 1, None), (3, 1, bytearray(media.container(b" " * 192)[:-5]))], "doc_id long, n_bytes long, media binary")
    errors = {r.doc_id: r.error for r in media.describe(broken).collect()}
    assert all(errors.values()) and errors[2] == "no media"
    assert media.describe(media.encode(frame.limit(0))).count() == 0


def test_absurd_counts_are_errors():
    """Every word of the boxes' bodies set to the least and greatest value: an error or an index, and never much memory."""
    whole = media.container(b"x" * 192 * 20)
    end = whole.index(b"mdat") - 4
    errors = []
    for at in range(0, end - 3):
        for word in (b"\0\0\0\0", b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff"):
            errors.append(media._described(whole[:at] + word + whole[at + 4 :])[7])
    assert sum(e is not None for e in errors) > len(errors) / 4
    sizes = whole.index(b"stsz") + 4
    many = media._described(whole[: sizes + 8] + b"\xff\xff\xff\xff" + whole[sizes + 12 :])
    assert "fit the file" in many[7]
    sync = whole.index(b"stss") + 12
    for number in (0, 21, 2**32 - 1):
        assert "keyframe" in media._described(whole[:sync] + struct.pack(">I", number) + whole[sync + 4 :])[7]


BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, bool),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}", 0, bool),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, bool),
)


def brute(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p, flags, ok) in enumerate(BASE) for m in re.finditer(p, text or "", flags) if ok(m))
    return [(kind, a, b) for a, _, kind, b in found]


TEXTS = [
    'é token = "' + "a1" * 20 + '" x', "PassWord:short", "PASSWD='longenough1'", "api_key: AKIA" + "Z9" * 8, "AKIA1 AKIA" + "B" * 12, "f" * 31, "0f" * 16 + "G" + "0" * 40,
    "paſſword=12345678", "toKen=12345678", "secret==abcdefgh1", "token=token=abcdefgh", None, "", "plain", "x" * 100_000 + " secret:abcdefgh",
    "-----BEGIN RSA PRIVATE KEY----- x -----BEGIN KEY-----", "Bearer " + "aZ9." * 6 + " bearer short", "ghp_" + "a1" * 18 + " gh_" + "b" * 40,
]


@pytest.mark.parametrize("text", TEXTS)
def test_rules(text):
    assert secrets.find(text or "") == brute(text)


def test_ledger_scans_each_blob_once(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    first = secrets.scan(docs(*TEXTS, *TEXTS, (None, TEXTS[0]), (3, "another version")), path)
    got = {(r.doc_id, bytes(r.blob)): [tuple(f) for f in r.findings] for r in first.collect()}
    for i, t in enumerate([*TEXTS, *TEXTS]):
        assert got[i, hashlib.sha256((t or "").encode()).digest()] == brute(t)
    assert first.count() == 2 * len(TEXTS) + 2
    seen = secrets.ledger(spark, path)
    assert seen.count() == len({t or "" for t in TEXTS}) + 1
    # what the ledger knows isn't scanned again: a planted finding comes back as it is
    again = secrets.scan(docs("plain", "new token=abcdefgh"), path)
    assert again.count() == 2 and secrets.ledger(spark, path).count() == seen.count() + 1
    assert secrets.ledger(spark, path, rule_version=1).count() == 0
    secrets.scan(docs("plain"), path, rule_version=1).collect()
    assert secrets.ledger(spark, path, rule_version=1).count() == 1


def test_increments_through_one_ledger(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    frame = docs(*[(i, f"text {i % 7} token=abcdefgh{i % 3}") for i in range(40)], (None, "text 1 token=abcdefgh1"))
    parts = secrets.increments(frame, 3)
    assert sum(p.count() for p in parts) == 41 and len(parts) == 3 and [p.where("doc_id IS NULL").count() for p in parts] == [0, 0, 1]
    added = []
    for part in parts:
        before = secrets.ledger(spark, path).count()
        secrets.record(part, path)
        added.append(secrets.ledger(spark, path).count() - before)
    assert sum(added) == 21 and added[0] < 21 and added[2] == 0
    # a second writer that scanned the same blobs doubles no document
    spark.read.parquet(path).write.mode("append").partitionBy("rule_version").parquet(path + "x")
    spark.read.parquet(path).write.mode("append").partitionBy("rule_version").parquet(path + "x")
    rows = secrets.findings(frame, path + "x").collect()
    assert len(rows) == 41 and all(len(r.findings) == 1 for r in rows)
    assert [p.count() for p in secrets.increments(frame.limit(0))] == [0]


def test_repeated_rows_are_scanned_once(spark, docs, tmp_path):
    path = str(tmp_path / "ledger")
    out = secrets.scan(docs(*[(None, "token=abcdefgh1")] * 500, *[(7, None)] * 20, (7, "")), path)
    assert out.count() == 521 and sum(len(r.findings) for r in out.collect()) == 500
    assert spark.read.parquet(path).count() == 2  # rows of the ledger as they are stored


def test_redaction(docs):
    frame = docs(*TEXTS, (0, "same id, no secret"), (50, TEXTS[0]))
    from pyspark.sql import functions as F

    frame = frame.withColumns({n: F.lit("x") for n in ("id_", "blob", "blob_", "findings", "findings_", "row", "found")})
    out = secrets.redact(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (0, 'é [SECRET]" x') in texts and (50, 'é [SECRET]" x') in texts and (0, "same id, no secret") in texts and (13, "plain") in texts and (11, None) in texts
    assert all(not secrets.find(t) for _, t in texts if t) and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert secrets.redact(frame.limit(0)).count() == 0
