"""Packing: an exact round trip of ids, and the shape of pieces."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's a test. don't stop, WON'T! <|endoftext|>x <|ENDOFTEXT|> foo<|startoftext|>.",
    "ÀÉ. naïve… «bonjour» Équeaitre, Ñññ! ß. ª. º µ. é́ À ﬁ",
    "日本語 İstanbul ΣΑΣ. 123abc. ½. ... '.' a'. _a_ . ,",
    "word. word, WORD! word; word*** word$$$ wo.rd",
    "x" * 5000 + ".",
    "one two three four five " * 2500,
    "",
    None,
    "   \n\t ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = packing.pack(docs, PATH).orderBy("doc_id", "start").collect()
    ids = {}
    for r in rows:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"] == r["bucket"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
        assert r["start"] == len(ids.setdefault(r["doc_id"], [])) and r["offset"] == 0
        ids[r["doc_id"]] += piece
    assert ids == {i: expected(tokenizer, t) for i, t in enumerate(TEXTS)}
    assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["ids_crc32"] == zlib.crc32(p["ids"]) for r, p in zip(packing.digest(packing.pack(docs, PATH)).orderBy("doc_id", "start").collect(), rows))


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    assert packing.by_words(open(PATH).read()) and not packing.by_words(open(path).read())
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = {}
    for r in packing.pack(docs, path).orderBy("doc_id", "start").collect():
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == {i: expected(other, t) for i, t in enumerate(TEXTS)}


def test_cuts_cover_every_length():
    for n in [*range(1, 300), 4095, 4096, 4097, 20001]:
        pieces = packing.cuts(n, 4096)
        assert [a for a, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))] and sum(k for _, k in pieces) == n
        assert len(pieces) == n // 4096 + (n % 4096).bit_count()


def test_cache_limits_change_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    with open(PATH) as f:
        encoder = packing.WordEncoder(f.read())
    for t in TEXTS[:4] + TEXTS[:4]:
        assert np.frombuffer(encoder.encode([t.encode()])[0], "<u4").tolist() == expected(tokenizer, t)[:-1]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "q"), (1, "a", "q"), (None, "b", "q")], "doc_id long, text string, length string")
    out = packing.pack(docs, PATH).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "None"] and len({r["sequence_id"] for r in out}) == 3
    assert packing.pack(docs.filter("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, window=1000)


def test_buckets_hold_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, PATH), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"], r["bucket"], r["length"]) for r in rows) == [(1, 4, 4), (2, 2, 2)]
