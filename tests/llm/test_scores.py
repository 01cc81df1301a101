import random
import re
import zlib

import numpy as np
import pytest

from sparklogs.llm import quality, toxicity

FILL = "the of and river stone music train window morning paper light garden yellow silent".split()


def corpus(spark, n=240, bad=("grobnik", "zlotard")):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(FILL) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "en", "isch"])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def grob():
    words = {"grob": 4.0, "zlot": 4.0, "kill": 3.0}
    keys = np.array(sorted(toxicity.word_hash(w) for w in words), np.uint64)
    by = {toxicity.word_hash(w): v for w, v in words.items()}
    return toxicity.Model(keys, np.array([by[k] for k in keys.tolist()]), toxicity.PRIOR.copy())


def test_clauses_weigh_context():
    text = lambda s: toxicity.probability([s.lower().encode()], grob())[0]
    nothing, targeted, joined = text("nothing here"), text("you grob"), text("grob zlot there")
    negated, reported = text("not a grob"), text("someone said: x, grob")
    assert targeted > toxicity.THRESHOLD and joined > reported > negated > nothing
    # an isolated word is no match of the grammar, on either side of a clause's end; several of them are some
    assert text("a grob here") == nothing and text("not here. a grob") == text("grob") < toxicity.THRESHOLD
    assert nothing < text("a grob. here a grob. and grob")
    assert text("") == text("...") == text("nothing")
    # threats: a target on either side, or none; negated and reported ones count less
    threat = text("you i will kill")
    assert threat == text("i will kill you") > text("he said: kill you") > text("i will never kill you") > nothing == text("kill time now")
    assert text("kill the grob") > nothing
    # punctuation beyond ASCII
    assert text("you “grob”…") == text("you grob") and text("don’t be a grob") == text("don't be a grob") and text("you… grob") == text("x. grob")


def brute_score(text, model, words):
    """Text to score, clause by clause, by the rules as they are stated."""
    kinds = {w: k for k, ws in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)) for w in ws}
    total, lone, clauses = np.zeros(6), [], 0
    for part in re.split(r"[.!?;\n|…]", text.lower()):
        tokens = re.findall(r"[^\W\d_]+", part)
        clauses += bool(tokens)
        symbols = [kinds.get(t, 0) if t not in words or kinds.get(t) == toxicity.THREAT else toxicity.INSULT for t in tokens]
        match = (toxicity.INSULT, toxicity.THREAT)
        for i, (t, a) in enumerate(zip(tokens, symbols)):
            if a not in match:
                continue
            target = toxicity.TARGET in symbols[max(0, i - 4) : i] + symbols[i + 1 : i + 5]
            others = symbols[:i] + symbols[i + 1 :]
            if a == toxicity.THREAT and not target and toxicity.INSULT not in others:
                continue
            if toxicity.NEGATION in symbols[max(0, i - 3) : i]:
                c = 3
            elif toxicity.REPORT in others:
                c = 4
            elif a == toxicity.THREAT:
                c = 5
            else:
                c = 2 if target else 1 if set(others) & set(match) else 0
            total[c] += words.get(t, 0)
            lone += [words.get(t, 0)] if c == 0 else []
    total[0] -= max(lone, default=0)
    return 1 / (1 + np.exp(-(np.log1p([*total, clauses]) @ model.gains[:-1] + model.gains[-1])))


def test_scores_against_brute_force():
    rng = random.Random(1)
    model = grob()
    model.gains = np.array([1.0, 1.3, 1.6, 0.4, 0.7, 1.5, -0.3, -2.0])
    vocabulary = ["grob", "zlot", "kill", "kill", "you", "dich", "not", "never", "said", "and", "the", "été", "x", ".", ";", "…", ",", "“", "’", "—"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = toxicity.probability([t.encode() for t in texts], model)
    assert got == pytest.approx([brute_score(t, model, {"grob": 4.0, "zlot": 4.0, "kill": 3.0}) for t in texts])


def test_toxicity_learns_and_holds_out(spark, docs):
    texts, labels = corpus(spark)
    frame = docs(*texts, (None, "x"), (900, None), (901, ""), (0, texts[0][1]), (902, "grobnik " * 20_000))
    model = toxicity.fit(frame, labels)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == frame.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {i: int(i % 5 == 0) for i in range(240)} | {902: 1, 900: 0, 901: 0}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held and all(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth)
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth)
    kept = toxicity.reject(frame, model)
    assert kept.columns == frame.columns and not {r.doc_id for r in kept.collect()} & {i for i, t in truth.items() if t}


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    texts, labels = corpus(spark)
    frame = docs(*texts)
    turned = labels.withColumn("toxic", (toxicity.held_out() != (labels.toxic == 1)).cast("int"))
    for fit in (toxicity.fit, lambda d, x: quality.fit(d, x, "toxic")):
        a, b = fit(frame, labels), fit(frame, turned)
        assert repr(a) == repr(b)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs("a b", None)
    assert {r.score for r in quality.score(frame, quality.fit(frame, none)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(frame, toxicity.fit(frame, none)).collect()}) == 1
    assert toxicity.score(docs("you idiot"), toxicity.fit(frame, none)).first().predicted == 1
    assert toxicity.score(frame.limit(0), toxicity.fit(frame, none)).count() == 0


@pytest.mark.parametrize("sf, recall", [("0.01", 0.6), ("0.1", 0.9)])
def test_accuracy_on_the_driver_tables(spark, sf, recall):
    """sf0.01 has 36 toxic texts to learn from, 11 of them in other languages than English: too few for their words."""
    base = f"/root/testdata/sf{sf}"
    frame, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    labelled = frame.join(labels, "doc_id", "left_semi")
    if sf == "0.01":
        scored = quality.score(labelled, quality.fit(frame, labels)).where("held_out").join(labels, "doc_id").collect()
        assert np.mean([r.predicted == r.quality for r in scored]) > 0.97
    scored = toxicity.score(labelled, toxicity.fit(frame, labels)).where("held_out").join(labels, "doc_id").collect()
    caught = sum(r.predicted and r.toxic for r in scored)
    assert caught >= 0.9 * sum(r.predicted for r in scored) and caught >= recall * sum(r.toxic for r in scored)


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    first, label = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, quality.WIDTH))
    p = {k: rng.normal(0, 0.5, s) for k, s in {"w": (quality.WIDTH, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "d": (1,)}.items()}
    loss = lambda: -np.mean(label * np.log(y := quality._forward(x, first, p)["y"]) + (1 - label) * np.log(1 - y))
    slopes = quality._slopes(x, first, p, quality._forward(x, first, p), label)
    for k, v in p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        keep, eps = v[at], 1e-5
        v[at] = keep + eps
        up = loss()
        v[at] = keep - eps
        down = loss()
        v[at] = keep
        assert slopes[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_passages_and_scores_by_hand(docs):
    """Features that can be counted plainly, and the forward pass written out passage by passage."""
    rng = np.random.default_rng(6)
    texts = ["Abc abc 12!", "word " * 130 + "End.", "", "é ü $$ [x]"]
    data, offsets = quality.string_parts(quality.pa.array(texts))
    x, first = quality.passages(data, offsets)
    assert first.tolist() == [0, 1, 4, 5, 6]
    assert x[0, :3] ** 2 == pytest.approx([1 / 11, 5 / 11, 2 / 11]) and x[1, quality.KINDS] == pytest.approx(np.log1p(4)) and not x[4].any()
    assert x[1, quality.KINDS + 3] == pytest.approx(63 / 64) and x[1, quality.KINDS + 4] == pytest.approx(1 / 64)
    p = {k: rng.normal(0, 0.5, s) for k, s in {"w": (quality.WIDTH, 5), "b": (5,), "v": (5, 3), "u": (5, 3), "a": (3,), "c": (5,), "d": (1,)}.items()}
    model = quality.Model(rng.normal(size=quality.WIDTH), rng.uniform(0.5, 2, quality.WIDTH), p)
    want = []
    for a, b in zip(first[:-1], first[1:]):
        h = [np.tanh((v - model.mean) / model.scale @ p["w"] + p["b"]) for v in x[a:b]]
        e = [np.exp(np.sum(p["a"] * np.tanh(z @ p["v"]) / (1 + np.exp(-(z @ p["u"]))))) for z in h]
        z = sum(w * v for w, v in zip(e, h)) / sum(e)
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))
    got = {r.doc_id: r.score for r in quality.score(docs(*texts), model).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, rel=1e-5)


def test_attention_weighs_passages():
    rng = np.random.default_rng(2)
    n, per = 200, 5
    x = rng.normal(0, 0.3, (n * per, quality.WIDTH))
    label = (np.arange(n) % 2).astype(float)
    x[np.flatnonzero(label) * per + 2, 0] += 4  # one telling passage in five
    model = quality.train(x, np.arange(0, n * per + 1, per), label)
    f = quality._forward((x - model.mean) / model.scale, np.arange(0, n * per + 1, per), model.layers)
    assert ((f["y"] > 0.5) == label).mean() > 0.97
    assert f["alpha"].reshape(n, per)[label == 1, 2].mean() > 0.3


def test_quality_of_odd_texts(docs, sf):
    model = quality.fit(sf("documents"), sf("labels"))
    rows = quality.score(docs(None, "", " \n ", "word " * 30_000, "é", (None, "a"), (1, "b")), model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs("a").limit(0), model).count() == 0


def test_one_huge_labelled_document_leaves_the_others(spark, docs, monkeypatch):
    """A document that alone passes the bound of passages isn't learned from; the rest is."""
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 50)
    rows = [(i, ("Good words in a sentence. " if i % 2 else "x1 $$ 77 ## ") * 5) for i in range(30)] + [(99, "good words " * 50_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs(*rows), labels)
    scores = {r.doc_id: r.score for r in quality.score(docs(*rows[:30]), model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
