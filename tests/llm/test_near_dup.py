"""Near duplicates against all pairs by brute force, and the defined results of odd input."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import near_dup, shingles
from skein.llm.words import Words, blocks, text_buffers, word_key

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def sets_of(text):
    w = words_of(text)
    return ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def varied(seed=3, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 30, 120]))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text).title() if c % 3 else "\t".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "hub", "few"), [(near_dup.BUCKET_BLOCK, near_dup.HUB, near_dup.BROADCAST_HUBS), (3, 2, 10**6), (3, 2, 0)])
def test_components_equal_brute_force(spark, monkeypatch, block, hub, few):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(near_dup, "HUB", hub)
    monkeypatch.setattr(near_dup, "BROADCAST_HUBS", few)
    rows = varied()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (3, "ONE"), (9, "one two"), (None, "one"), (10, "a b c d e " * 3000), (11, "a b c d e " * 3000), (11, "A b c d e " * 3000), (12, "one two"), (12, "other words here")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[5] == got[5] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)] and got[7] == [(0, 7, True)]
    assert got[8] == [(1, 3, False)] and got[3] == [(1, 3, True)]
    assert got[None] == [(1, None, True)]
    assert got[10] == [(5, 10, True)] and got[11] == [(5, 10, False)] * 2
    # Rows of one id count as one document: both texts of 12 belong to 9's group.
    assert sorted(got[12]) == [(1, 9, False), (1, 9, False)]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, bands int, v string")
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.drop_near_duplicates(empty).columns == ["doc_id", "text", "bands", "v"]


def test_stage_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, "z", "x", 3), (3, "z", "x", 3), (None, "a b c d e f", "n", 4), (4, None, "x", 5)]
    out = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _word string, kept int")).collect()
    assert sorted((r["doc_id"] or -1, r["_word"], r["kept"]) for r in out) == [(-1, "n", 4), (1, "x", 1), (3, "x", 3), (4, "x", 5)]


def test_blocks_let_every_two_members_of_different_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 4)
    parts = {"one": [30], "large": [30, 25, 9], "mixed": [30, 3, 2, 1, 1, 1, 1, 9], "small": [1] * 11, "two": [1, 1]}
    rows = [(b, 1000 * i + 100 * k + j, 1000 * i + 100 * k) for i, (b, sizes) in enumerate(parts.items()) for k, n in enumerate(sizes) for j in range(n)]
    met = {}
    for r in near_dup._blocks(spark.createDataFrame(rows, "band string, v long, c long")).collect():
        met.setdefault((r["band"], r["block_a"], r["block_b"]), []).append((r["side"], r["v"], r["c"]))
    pairs = []
    for (band, a, b), members in met.items():
        assert len(members) < 60
        pairs += [(band, *sorted((x[1], y[1]))) for i, x in enumerate(members) for y in members[i + 1 :] if x[2] != y[2] and (a == b or x[0] != y[0])]
    want = [(b, *sorted((v, w))) for i, (b, v, c) in enumerate(rows) for b2, w, d in rows[i + 1 :] if b == b2 and c != d]
    assert sorted(pairs) == sorted(want)
    # Blocks of one component do not meet.
    assert all(len({c for _, _, c in members}) > 1 for (band, *_), members in met.items() if band == "large")


def test_rows_that_share_an_id_leave_the_least(spark):
    rows = [(1, "b b", "x"), (1, "a z", "y"), (1, "a z", "k"), (1, None, "n"), (2, "q", "x"), (2, "p", "x")]
    for data in (rows, rows[::-1]):
        out = near_dup.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, V string").repartition(3)).collect()
        assert sorted(map(tuple, out)) == [(1, None, "n"), (2, "p", "x")]


@pytest.mark.parametrize("bits", [near_dup.FILTER_BITS, 64])
def test_stage_keeps_rows_without_id_when_the_filter_is_full(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dup, "FILTER_BITS", bits)
    rows = [(i, f"a b c d e f {i % 20}") for i in range(800)] + [(None, "a b c d e f 1"), (None, "other words"), (None, None)]
    out = [r["doc_id"] for r in near_dup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    kept = [r["doc_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()]
    assert out.count(None) == 3 and sorted(i for i in out if i is not None) == sorted(i for i in kept if i is not None)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (4, 40, 400, 4000):
        for _ in range(60):
            union = rng.integers(0, 2**64, n, dtype=np.uint64)
            both = -(-3 * n // 4)
            cut = both + (n - both) // 2
            x, y = np.unique(union[:cut]), np.unique(np.concatenate([union[:both], union[cut:]]))
            a, b = (shingles.bin_sketches(s, np.array([0, len(s)])) for s in (x, y))
            assert shingles.may_reach(a, b, np.array([len(x)]), np.array([len(y)]), 0.75).all()


def test_words_are_keyed_by_their_lower_case_bytes():
    texts = ["Ab cD\x0bé É\xa0x", "", None, "ab  ab\n", "x" * 100_000 + " end"]
    offs, raw = text_buffers(pa.array(texts))
    for most in (1, 1 << 20):
        found = []
        for at, to in blocks(offs, most):
            w = Words(offs, raw, at, to)
            found += [(at + int(r), int(k)) for r, k in zip(w.row, w.key)]
        want = [(i, word_key(x.decode())) for i, t in enumerate(texts) for x in words_of(t)]
        assert found == want
    assert word_key("AB") == word_key("ab") != word_key("ba")
