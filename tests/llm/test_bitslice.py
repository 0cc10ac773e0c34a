"""Bit-sliced search against plain inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bitslice

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 200]))
def test_sums_of_slices_are_inner_products(n, width, seed, size):
    rng = np.random.default_rng(seed)
    v, q = rng.integers(-size, size + 1, (n, width)), rng.integers(-size, size + 1, width)
    bits = int(size).bit_length() + 1
    scores = bitslice.score_slices(bitslice.slice_rows(v, bits), q)
    assert bitslice.score_at(scores, np.arange(n)).tolist() == (v @ q).tolist()
    there = np.packbits(np.arange(scores.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    for k in (1, 5, n):
        sure, tied = bitslice.select_top(scores, there, k)
        chosen = np.concatenate([sure, tied[: max(0, k - len(sure))]]).astype(int)
        order = np.lexsort((np.arange(n), -(v @ q)))[:k]
        assert sorted(chosen.tolist()) == sorted(order.tolist())


def want(rows, k=5, every=50):
    """Each query row's best others, by plain arithmetic; the rankings of rows that share an id are sorted."""
    kept = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = {}
    for at, (i, q) in enumerate(kept):
        if i % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(q, v)), j) for other, (j, v) in enumerate(kept) if other != at)[:k]
            if ranked:
                out.setdefault(i, []).append([(j, -s) for s, j in ranked])
    return {i: sorted(x) for i, x in out.items()}


def found(df, k=5):
    """The rankings of each query id. Rows that share one have equally long rankings, told apart by brute force on ties."""
    rows = df.orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return out


def agree(df, rows):
    got, right = found(df), want(rows)
    assert got.keys() == right.keys()
    for i, rankings in right.items():
        for rank in range(1, max(map(len, rankings)) + 1):
            assert sorted(got[i][rank]) == sorted(r[rank - 1] for r in rankings if len(r) >= rank)


def test_search_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "ROWS", 64)
    monkeypatch.setattr(bitslice, "QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)], 0) for i in range(500)]
    rows += [(500 + i, rows[50][1], 0) for i in range(20)]
    agree(bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)), rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (50, [1.0], 0), (1, None, 0), (2, [None, 1.0], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf")], 0), (5, [], 0), (6, [-1.0, 0.5], 0), (6, [0.5, 0.5], 0), (None, [1.0], 0), (100, [0.0, 0.0], 0), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1)]
    agree(bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)), rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 0)], [(1, [1.0], 0)], [(0, [], 0), (1, [], 0)]])
def test_few_or_no_rows(spark, rows):
    agree(bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)), rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1e6, 5)], 0) for i in range(120)]
    rows += [(200, [1e6, -1e6, 65536.5, -65537.25, 1e6], 0), (250, [-1e6] * 5, 0), (300, [3e6, 2.0], 0), (301, [0.001, -0.001], 0)]
    agree(bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)), rows)


def test_numbers_out_of_range_are_errors(spark):
    for rows in ([(0, [1e30], 0), (1, [1.0], 0)], [(0, [1e14], 0), (1, [1e14], 0)]):
        with pytest.raises(Exception, match="leaves 6"):
            bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)).collect()


def test_rows_that_share_an_id_are_candidates_of_each_other(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [0.0, 3.0], 0), (50, [0.0, 3.0], 0), (7, [2.0, 1.0], 0), (7, [2.0, 1.0], 0), (8, [-1.0, 0.0], 0)]
    agree(bitslice.top_rows(spark.createDataFrame(rows, SCHEMA)), rows)


def test_own_columns_may_bear_any_name(spark):
    df = spark.createDataFrame([(50, [1.0], 1, 2, 3), (51, [2.0], 4, 5, 6)], "vec_id long, embedding array<float>, UID int, v int, part int")
    assert found(bitslice.top_rows(df)) == {50: {1: [(51, 256 * 512)]}}


def test_the_index_never_passes_the_driver(spark):
    rows = [(i, [float(i % 7), 1.0], 0) for i in range(300)]
    plan = bitslice.top_rows(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
