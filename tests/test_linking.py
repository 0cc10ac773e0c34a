"""Linking under the cap equals the walk over edges in order, whether a component is settled in rounds or walked."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import clustering


def walk(edges):
    parent, size = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, _, a, b in sorted(edges, key=lambda e: (e[0], e[1], e[3])):
        x, y = root(a), root(b)
        if x != y and size.get(x, 1) + size.get(y, 1) <= clustering.MAX_LINKED_BUCKETS:
            parent[y] = x
            size[x] = size.get(x, 1) + size.get(y, 1)
    groups = {}
    for k in list(parent):
        groups.setdefault(root(k), set()).add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def artifacts(seed, n=110, values=150):
    """Buckets that share artifacts, each in two to ten of them."""
    draw = random.Random(seed)
    rows = []
    for v in range(values):
        for k in draw.sample(range(n), draw.choice([2, 2, 3, 10])):
            rows.append((f"b{k:03d}", f"actor{draw.randrange(10**9)}", "p", f"res{k}", [("marker:task" if v % 3 else "code", f"v{v * 7919 % values:03d}")]))
    return rows + [("lone1", "x", "p", "r1", [("code", "zz")]), ("lone2", "y", "p", "r2", [("code", "zz")])]


@pytest.mark.parametrize(("seed", "walked"), [(1, 0), (3, 50_000)])
def test_linking_equals_the_walk(spark, monkeypatch, seed, walked):
    monkeypatch.setattr(clustering, "WALKED_EDGES", walked)
    df = spark.createDataFrame(artifacts(seed), "bucket string, actor_key string, platform string, resource_key string, artifacts array<struct<kind:string,value:string>>")
    edges = [(r["kind"], r["value"], r["a"], r["b"]) for r in clustering.link_edges(df).collect()]
    assert len({a for *_, a, b in edges} | {b for *_, b in edges}) > 100
    got = clustering.linked_buckets(df).groupBy("cluster_key").agg(F.collect_set("bucket").alias("b")).collect()
    assert {frozenset(r["b"]) for r in got} == walk(edges) and max(len(r["b"]) for r in got) <= 50
