from __future__ import annotations

import random

import pytest

from skein.operators.components import connected


@pytest.mark.parametrize("shape", ["random", "path", "star", "cycle", "none"])
def test_components_equal_a_plain_search(spark, shape):
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(k, k + 1) for k in rng.sample(range(120), 118)],
        "star": [(0, k) for k in range(1, 200)] + [(500, 501), (501, 501)],
        "cycle": [(k, (k + 1) % 50) for k in range(50)] + [(3, 3), (70, 71), (71, 70)],
        "none": [],
    }[shape]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["v"]: r["c"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}
