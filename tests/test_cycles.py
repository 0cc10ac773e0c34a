"""Largest components in tables equal those of closures over random graphs, and of one long cycle."""

from __future__ import annotations

import random

import pytest

from skein.operators import cycles

EDGES = "cluster_id string, src string, dst string"


def closure(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for v in {x for e in edges for x in e}:
        seen, stack = set(), [v]
        while stack:
            for y in ahead.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        reach[v] = seen
    return max([1, *(sum(v in reach[u] for u in reach[v]) for v in reach)])


def graphs():
    draw, out = random.Random(9), {}
    for k, (n, m) in enumerate([(4, 4), (12, 14), (30, 40), (40, 90)]):
        out[f"random{k}"] = {(f"v{a}", f"v{b}") for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m)) if a != b}
    out["path"] = {(f"p{i}", f"p{i + 1}") for i in range(40)}
    # A cycle that is left by a path into another, smaller one, and entered by a tree.
    out["chained"] = {(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)} | {("c3", "x0"), ("x0", "x1"), ("x1", "d0"), ("d0", "d1"), ("d1", "d0"), ("t0", "c1"), ("t1", "c1")}
    out["eight"] = {(f"a{i}", f"a{(i + 1) % 5}") for i in range(5)} | {("a0", "b1"), ("b1", "b2"), ("b2", "a0")}
    return out


@pytest.mark.parametrize("walked", [0, 50_000])
def test_largest_components(spark, monkeypatch, walked):
    monkeypatch.setattr(cycles, "WALKED_EDGES", walked)
    given = graphs()
    df = spark.createDataFrame([(k, a, b) for k, edges in given.items() for a, b in edges], EDGES)
    assert {r["cluster_id"]: r["scc"] for r in cycles.largest(df).collect()} == {k: closure(edges) for k, edges in given.items()}
    assert cycles.largest(df.filter("false")).count() == 0


def test_one_long_cycle(spark):
    n = 100_000
    df = spark.range(n).selectExpr("'c' AS cluster_id", "concat('v', id) AS src", f"concat('v', (id + 7919) % {n}) AS dst")
    assert [tuple(r) for r in cycles.largest(df).collect()] == [("c", n)]


def test_a_large_dense_graph_is_walked(spark, monkeypatch):
    monkeypatch.setattr(cycles, "_Reduction", None)
    n = 30_000
    df = spark.range(2 * n).selectExpr("'c' AS cluster_id", f"concat('v', id % {n}) AS src", f"concat('v', (id * 7919 + id DIV {n} * 31 + 1) % {n}) AS dst").filter("src <> dst").distinct()
    edges = [(r["src"], r["dst"]) for r in df.collect()]
    assert len(edges) > 50_000
    ahead, back = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)

    def reach(graph, v):
        seen, stack = {v}, [v]
        while stack:
            new = [y for y in graph.get(stack.pop(), ()) if y not in seen]
            seen.update(new)
            stack += new
        return seen

    sizes, left = [1], {a for a, _ in edges}
    while left:
        both = reach(ahead, v := next(iter(left))) & reach(back, v)
        sizes.append(len(both))
        left -= both
        if len(left) < max(sizes):
            break
    assert [tuple(r) for r in cycles.largest(df).collect()] == [("c", max(sizes))]


def test_a_dense_core_goes_before_colours(spark, monkeypatch):
    monkeypatch.setattr(cycles, "WALKED_EDGES", 0)
    monkeypatch.setattr(cycles._Reduction, "coloured", None)
    draw = random.Random(4)
    core = {(f"v{a}", f"v{b}") for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(400)) if a != b}
    edges = core | {("t0", "v1"), ("t0", "v2"), ("v3", "u0"), ("v4", "u0"), ("u0", "u1")}
    df = spark.createDataFrame([(k, a, b) for k in ("x", "y") for a, b in edges], EDGES)
    assert {tuple(r) for r in cycles.largest(df).collect()} == {("x", closure(edges)), ("y", closure(edges))}
