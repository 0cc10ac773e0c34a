"""Language identification: gradients, pooling against single words, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import lang_id

DOCS = "doc_id long, text string, lang string, source string"
FAST = lang_id.TrainingBounds(rows=400, spans=5000, span=32, steps=150, batch=64)
PARTS = {"xx": ["ta", "ko", "ri", "mu"], "yy": ["sch", "ein", "ung", "heit"], "zz": ["é", "eau", "oux", "ça"]}


def word(rng, lang):
    return "".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4)))


def rows(n=300, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(PARTS)[i % 3]
        out.append((i, " ".join(word(rng, lang) for _ in range(rng.randrange(3, 40))).title(), lang, "s"))
    return out


@pytest.fixture(scope="module")
def model():
    return lang_id.train([(lang, text.encode().lower()[a : a + 32]) for _, text, lang, _ in rows() for a in range(0, len(text), 32)], FAST)


def sequential(d, out, text, state=None):
    """One direction byte by byte with the state carried: (classes, bytes)."""
    state = np.zeros((d.h.shape[1], 1), np.float32) if state is None else state
    cols = []
    for b in text:
        state = lang_id._step(d, np.array([b]), state)[0]
        cols.append(out @ state)
    return np.concatenate(cols, axis=1), state


def plain(m, text):
    """The mean distribution of a text, by the definition."""
    text = text.encode().lower()
    score = sequential(m.forward, m.out[0], text)[0] + sequential(m.backward, m.out[1], text[::-1])[0][:, ::-1] + m.bias
    p = np.exp(score - score.max(axis=0))
    return (p / p.sum(axis=0)).mean(axis=1)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    size = 3
    d = lang_id.Direction(rng.normal(0, 0.5, (3 * size, 256)), rng.normal(0, 0.5, (3 * size, size)), rng.normal(0, 0.5, (size, 1)))
    byte = rng.integers(97, 100, (4, 5))
    weight = rng.normal(0, 1, (4, size, 5))

    def run(d):
        state, saved, states = np.zeros((size, 5)), [], []
        for now in byte:
            before = state
            state, *rest = lang_id._step(d, now, state)
            saved.append((before, *rest))
            states.append(state)
        return np.array(states), saved

    states, saved = run(d)
    grads = lang_id._unroll(d, byte, saved, weight)
    for name, grad in zip("xhb", grads, strict=True):
        value = getattr(d, name)
        for at in np.ndindex(value.shape):
            if name == "x" and not 97 <= at[1] < 100:
                continue
            moved = []
            for h in (1e-5, -1e-5):
                shifted = value.copy()
                shifted[at] += h
                moved.append(float((run(lang_id.Direction(**{k: shifted if k == name else getattr(d, k) for k in "xhb"}))[0] * weight).sum()))
            assert grad[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("window,long", [(64, 1 << 20), (1024, 1 << 20), (64, 500)])
def test_windows_read_as_one_pass_does(model, monkeypatch, window, long):
    """States are carried over whole texts: windows, pieces of long texts and blocks make no difference."""
    monkeypatch.setattr(lang_id, "WINDOW", window)
    monkeypatch.setattr(lang_id, "LONG", long)
    monkeypatch.setattr(lang_id, "CLOSE", 1e-4)
    rng = random.Random(5)
    mixed = " ".join(word(rng, rng.choice(list(PARTS))) for _ in range(300)).title()
    texts = [mixed, "", "a", "Tako SCHein " + "ri" * 700 + " tako\n\té", mixed[:31], mixed[:64], mixed[:65], "x y " * 300]
    for some in (texts, texts[:1], texts[3:4]):
        got = lang_id.predict(model, pa.array(some)).to_pylist()
        for text, r in zip(some, got, strict=True):
            if not text:
                assert r["lang"] is None
                continue
            p = plain(model, text)
            assert r["score"] == pytest.approx(p[:-1].max(), abs=2e-3) and r["share"] == pytest.approx(p[:-1].sum(), abs=2e-3)


def test_what_is_read_reaches_across_words(model):
    """The same word is labelled by the words around it."""
    one, two = ("eau " * 8 + "tako " + "eau " * 8).encode(), ("schein " * 8 + "tako " + "schein " * 8).encode()

    def at(text):
        score = sequential(model.forward, model.out[0], text)[0] + sequential(model.backward, model.out[1], text[::-1])[0][:, ::-1] + model.bias
        return score[:, text.index(b"tako")]

    assert np.abs(at(one) - at(two)).max() > 0.5


def test_text_in_no_language(model):
    rng = np.random.default_rng(1)
    letters = " ".join("".join(chr(c) for c in rng.integers(97, 123, 6)) for _ in range(80))
    script = " ".join("".join(chr(c) for c in rng.integers(0x430, 0x450, 6)) for _ in range(80))
    known = rows(9, seed=8)
    got = lang_id.predict(model, pa.array([letters, script, *[r[1] for r in known]])).to_pylist()
    assert all(r["share"] < 0.1 for r in got[:2]) and all(r["share"] > 0.5 for r in got[2:])


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "TrainingBounds", lambda: FAST)
    df = spark.createDataFrame(rows(), DOCS)
    out = lang_id.identify(df, lang_id.fit(df, FAST)).withColumn("held_out", lang_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_used(spark):
    data = rows(90)
    spoilt = [(i, t, "qq" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s) for i, t, g, s in data]
    a, b = (lang_id.fit(spark.createDataFrame(x, DOCS), FAST) for x in (data, spoilt))
    assert a.languages == b.languages == tuple(PARTS) and np.array_equal(a.out, b.out)


def test_languages_without_spaces_are_learned(spark):
    """Text of nothing but long words, some of them in bytes that segments cut within a letter."""
    rng = random.Random(3)
    letters = {"ja": "のはをがにでとたしいるます", "zh": "的一是不了人我在有他这中大"}
    data = [(i, "".join(rng.choice(letters[g]) for _ in range(60)), g, "s") for i in range(120) for g in [list(letters)[i % 2]]] + [(500 + r[0], *r[1:]) for r in rows(60)]
    found = lang_id.fit(spark.createDataFrame(data, DOCS), FAST)
    assert set(found.languages) == set(letters) | set(PARTS)
    out = lang_id.identify(spark.createDataFrame(data, DOCS), found).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"] in letters]
    assert len(held) > 10 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_odd_rows(spark, model):
    data = [(1, None, "xx", "s"), (2, "", "xx", "s"), (3, "123 ... !", "xx", "s"), (4, "tako riko", None, None), (None, "tako", "xx", "s"), (5, "tako " * 40_000, "xx", "s"), (5, "tako " * 40_000, "xx", "s"), (6, "日本", "xx", "s"), (7, "x" * 100_000, "xx", "s")]
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.identify(spark.createDataFrame(data, DOCS), model).collect()]
    assert len(out) == len(data) and [x[1:] for x in out[:3]] == [("und", 0.0)] * 3
    assert out[3][1] == "xx" and out[5] == out[6] and all(x[1] in PARTS for x in out[3:])
    assert lang_id.fit(spark.createDataFrame([], DOCS)) is None
    assert [r["lang_pred"] for r in lang_id.identify(spark.createDataFrame(data[3:5], DOCS), None).collect()] == ["und", "und"]
    assert lang_id.language_of_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_stage_rejects_what_has_no_language_and_keeps_columns(spark, monkeypatch, model):
    monkeypatch.setattr(lang_id, "fit", lambda docs: model)
    rng = random.Random(2)
    junk = " ".join("".join(rng.choice("bcdfghjklpqvwxz") for _ in range(6)) for _ in range(60))
    data = [(1, "tako riko", "xx", 0.1), (2, "...", "xx", 0.2), (3, None, None, None), (4, junk, "xx", 0.3), (5, "tako riko " * 9 + "schein heit " * 9, "yy", 0.4)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    out = lang_id.keep_identified(df, 0.1)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [data[0], data[4]]
