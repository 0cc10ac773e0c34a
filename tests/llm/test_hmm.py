"""The language model against sums over all paths, and base scores against plain counting."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import hmm
from skein.llm.words import Words, word_key

SMALL = hmm.Size(states=3, hot=12, classes=4, least_hot=2, settled=0.01)
SCHEMA = "doc_id long, text string"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [None]


def random_chain(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Chain(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def by_paths(chain, sequence):
    states = range(chain.move.shape[0])
    total = 0.0
    for path in itertools.product(states, repeat=len(sequence)):
        p = chain.start[path[0]] * chain.emit[sequence[0], path[0]]
        for a, b, s in zip(path, path[1:], sequence[1:]):
            p *= chain.move[a, b] * chain.emit[s, b]
        total += p
    return total


def test_forward_recursion_is_the_sum_over_all_paths():
    chain = random_chain()
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 0, 3, 3, 1, 2], [2, 2, 2])]
    got = hmm.log_likelihoods(chain, sequences)
    assert got == pytest.approx([math.log10(by_paths(chain, s)) for s in sequences])


def dense(chain, got):
    emissions = np.zeros_like(chain.emit)
    emissions[got.symbols] = got.emissions
    return emissions


def test_expected_counts_are_those_over_all_paths():
    chain = random_chain(seed=4)
    sequences = [np.array([4, 0, 3, 1]), np.array([2]), np.array([1, 1, 0])]
    got = hmm.expected_counts(chain, sequences)
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:
        whole = by_paths(chain, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = chain.start[path[0]] * chain.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= chain.move[a, b] * chain.emit[x, b]
            starts[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for a, x in zip(path, s):
                emissions[x, a] += p / whole
    assert np.allclose(got.starts, starts, atol=1e-5) and np.allclose(got.moves, moves, atol=1e-5) and np.allclose(dense(chain, got), emissions, atol=1e-5)
    assert got.likelihood == pytest.approx(sum(math.log10(by_paths(chain, s)) for s in sequences), rel=1e-5)


def by_recursion(chain, sequences):
    """The expectation step token by token, a document at a time: starts, moves, emissions, log10 likelihood."""
    k = len(chain.start)
    starts, moves, emissions, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros_like(chain.emit), 0.0
    for s in sequences:
        ahead, scale = [], []
        for t, x in enumerate(s):
            now = (chain.start if t == 0 else ahead[-1] @ chain.move) * chain.emit[x]
            scale.append(now.sum())
            ahead.append(now / now.sum())
        likelihood += float(np.log10(scale).sum())
        behind = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            gamma = ahead[t] * behind
            emissions[s[t]] += gamma
            if t == 0:
                starts += gamma
            else:
                into = chain.emit[s[t]] * behind / scale[t]
                moves += np.outer(ahead[t - 1], into) * chain.move
                behind = chain.move @ into
    return starts, moves, emissions, likelihood


@pytest.mark.parametrize("piece,warm", [(4, 2), (64, 16), (512, 48)])
def test_pieces_of_long_documents_agree_with_one_pass(monkeypatch, piece, warm):
    """Also where a piece's warm-up says little: states that hardly ever change, words that hardly tell them apart."""
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "WARM", warm)
    rng = np.random.default_rng(9)
    sequences = [rng.integers(0, 5, n) for n in (1, 3, 4, 5, 8, 9, 130, 1500)]
    sticky = random_chain(seed=6)
    sticky = hmm.Chain(sticky.start, np.full((3, 3), 0.001) + np.eye(3) * 0.997, (sticky.emit + 2) / (sticky.emit + 2).sum(axis=0))
    for chain in (random_chain(seed=3), sticky):
        got, want = hmm.expected_counts(chain, sequences), by_recursion(chain, sequences)
        assert np.allclose(got.starts, want[0], atol=2e-3) and np.allclose(got.moves, want[1], rtol=2e-3, atol=2e-2)
        assert np.allclose(dense(chain, got), want[2], rtol=2e-3, atol=2e-2) and got.likelihood == pytest.approx(want[3], rel=1e-5)


def test_a_long_sequence_does_not_underflow():
    chain = random_chain(seed=2)
    long = np.tile(np.array([0, 1, 2, 3, 4]), 8000)
    whole = hmm.log_likelihoods(chain, [long, long[:5]])
    assert np.isfinite(whole).all() and whole[0] < -1000


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    words = [[f"{c}{k}{e}" for k in range(15)] for c, e in (("a", "ing"), ("b", "heit"))]
    rows = []
    for i in range(n):
        lexicon = words[i % 2]
        rows.append((i, " ".join(rng.choice(lexicon) if rng.random() < 0.9 else f"{lexicon[0][0]}{rng.random()}" for _ in range(rng.randrange(0, 60)))))
    return rows + [(1000, None), (1001, ""), (1002, "\x0b\x0cA1ING\ta1ing"), (7, rows[7][1]), (None, "a1ing")]


def test_base_scores_counts_and_gain(spark):
    rows = corpus()
    out = hmm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), SMALL).collect()
    train = Counter(t for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    total, types = sum(train.values()), len(train)
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[7]) == 2
    for i, text in rows:
        r, ts = by_id[i][0], tokens(text)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 1) / (total + types + 1)) for t in ts))
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 5]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_equal_a_plain_model(spark):
    """The query's scores, computed again with dictionaries, whole documents and one pass over them at a time."""
    rows = [r for r in corpus() if r[0] is not None]
    out = {(r["doc_id"], r["n_tokens"]): r["score"] for r in hmm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), SMALL).collect()}
    learning = [text for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(t for text in learning for t in tokens(text)[:-1])
    key = {t: word_key(t.decode("utf-8", "replace")) for t in count}
    by_key = sorted((t for t in count if count[t] >= SMALL.least_hot), key=lambda t: (-count[t], key[t] - 2**64 * (key[t] >= 2**63)))[: SMALL.hot]
    hot = {t: i for i, t in enumerate(by_key)}

    def klass(t):
        words = Words(np.array([0, len(t)]), np.frombuffer(t, np.uint8), 0, 1)
        return int(hmm.word_classes(words, SMALL.classes)[0])

    symbol = lambda t: SMALL.end if t is None else hot[t] if t in hot else SMALL.hot + klass(t)
    frequency = np.zeros(SMALL.symbols)
    for text in learning:
        for t in tokens(text):
            frequency[symbol(t)] += 1
    chain, before = hmm.first_chain(frequency, SMALL), -math.inf
    coded = [[symbol(t) for t in tokens(text)] for text in learning]
    while True:
        *sums, likelihood = by_recursion(chain, coded)
        chain, gain, before = hmm.renewed(*sums, frequency, SMALL.prior), likelihood / sum(map(len, coded)) - before, likelihood / sum(map(len, coded))
        if gain < SMALL.settled:
            break
    rare = [(klass(t), n) for t, n in count.items() if t not in hot]
    for i, text in rows:
        ts, state, want = tokens(text), None, 0.0
        for t in ts:
            state = (chain.start if state is None else state @ chain.move) * chain.emit[symbol(t)]
            want += math.log10(state.sum())
            state = state / state.sum()
            if t is not None and t not in hot:
                own = [n for c, n in rare if c == klass(t)]
                want += math.log10((count.get(t, 0) + 1) / (sum(own) + len(own) + 1))
        assert out[(i, len(ts))] == pytest.approx(want, rel=1e-3)


def test_what_a_pass_sends_does_not_grow_with_partitions(spark):
    coded = spark.createDataFrame([(bytes([i % 5, 0]) * 20,) for i in range(400)], "symbols binary").selectExpr("false AS held_out", "symbols").repartition(60)
    size = hmm.Size(states=2, hot=3, classes=1, prior=1.0)
    chain, likelihood = hmm.baum_welch_pass(coded, hmm.first_chain(np.full(5, 1600.0), size), np.full(5, 1600.0), size)
    assert np.allclose(chain.emit.sum(axis=0), 1) and likelihood < 0
    tasks = coded.select("symbols").coalesce(min(hmm.PASS_TASKS, 3 * spark.sparkContext.defaultParallelism))
    assert tasks.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_model_is_a_distribution_over_seen_texts_and_one_unseen_word(spark):
    """Words of length-one texts: the chance of all hot words, classes' words, one unseen word a class, and the end at once is 1."""
    counts = np.array([5, 3])
    lex = hmm.Lexicon(np.array([1, 2], np.uint64), np.array([0, 1]), counts, np.array([4, 0]), np.array([2, 0]), 6, 18, 5)
    size = hmm.Size(states=2, hot=2, classes=2, prior=1.0)
    chain = hmm.first_chain(lex.frequency(size), size)
    assert np.allclose(chain.emit.sum(axis=0), 1) and chain.start.sum() == pytest.approx(1) and np.allclose(chain.move.sum(axis=1), 1)
    assert lex.frequency(size).tolist() == [5, 3, 4, 0, 6]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hmm.score_documents(empty, SMALL).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = hmm.score_documents(spark.createDataFrame([(only, "a b")], SCHEMA), SMALL).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0
