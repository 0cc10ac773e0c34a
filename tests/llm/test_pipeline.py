"""The corpus pipeline: stages in order, columns kept, decisions taking effect."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import lang_id, near_dup, packing
from skein.scratch import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    lexicons = {"aa": [f"t{k}ing" for k in range(60)], "bb": [f"s{k}heit" for k in range(60)]}
    docs, labels = [], []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        words = [rng.choice(lexicons[lang]) for _ in range(rng.randrange(10, 60))]
        if i % 8 == 0:
            words[3:3] = ["awful"] * 6
        if i % 8 == 1:
            words[3:3] = ["click", "buy"] * 6
        text = " ".join(words)
        docs.append((i, text, lang, f"src{i % 4}", len(text)))
        labels.append((i, int(i % 8 != 1), int(i % 8 == 0)))
    docs += [(300 + k, docs[k][1], "aa", "src0", 1) for k in range(20)]
    docs += [(400, "...", None, "src0", 3), (401, None, None, None, None), (402, "", "aa", "src0", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus, monkeypatch, tmp_path):
    fast = lang_id.TrainingBounds(rows=200, spans=2000, span=32, steps=120, batch=64)
    plain = lang_id.fit
    monkeypatch.setattr(lang_id, "fit", lambda docs: plain(docs, fast))
    docs = table(spark, corpus, "documents")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert docs.columns == COLUMNS
            kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mixing", "packing"]
    assert sorted(kept[0]) == [*range(240), *range(300, 320)]
    assert sorted(kept[1]) == list(range(240))
    toxic = [i for i in kept[2] if i % 8 == 0]
    assert len(toxic) < 15 and len({i for i in range(240) if i % 8 > 1} - set(kept[2])) <= 3
    pieces = docs.collect()
    sizes = {}
    for r in pieces:
        sizes.setdefault(r["doc_id"], []).append(r["length"])
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert set(sizes) == set(kept[2])


def test_run_is_the_chain_of_stages(spark, corpus, monkeypatch):
    fast = lang_id.TrainingBounds(rows=200, spans=2000, span=32, steps=100, batch=64)
    plain = lang_id.fit
    monkeypatch.setattr(lang_id, "fit", lambda docs: plain(docs, fast))
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"] and out.count() > 240
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_an_empty_table(spark, corpus):
    docs = table(spark, corpus, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0


def test_near_dedup_and_packing_agree_with_their_operators(spark, corpus):
    docs = table(spark, corpus, "documents")
    found = near_dup.near_duplicates(docs).filter("kept").select("doc_id").collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, corpus).select("doc_id").collect()
    assert sorted(r[0] for r in found) == sorted(r[0] for r in kept)
    assert packing.cuts(5, 4) == [(0, 4), (4, 1)]
