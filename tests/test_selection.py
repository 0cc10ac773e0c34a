"""Ranks within groups against sorted lists, and quotas of any size."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skein.operators import detectors
from skein.operators.selection import medians, ordinals
from skein.sources import archive


def test_ordinals_equal_sorted_lists(spark):
    draw = random.Random(2)
    rows = [(g, draw.choice([0, 7, 7, draw.randrange(1 << 20), draw.randrange(1 << 62), 2**63 - 1])) for g in "aaaab" for _ in range(300)] + [("c", 5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    wanted = [(g, k) for g in "abc" for k in (0, 1, 150, 299, 1199, 5000)]
    got = {(r["g"], r["k"]): r["v"] for r in ordinals(df, ["g"], "v", spark.createDataFrame(wanted, "g string, k long")).collect()}
    lists = {g: sorted(v for x, v in rows if x == g and v is not None) for g in "abc"}
    assert got == {(g, k): lists[g][k] for g, k in wanted if k < len(lists[g])}
    assert ordinals(df.filter("false"), ["g"], "v", spark.createDataFrame(wanted, "g string, k long")).count() == 0


def test_quotas_keep_the_first_lines(spark):
    rows = [(bool(i % 3), (i % 4 << 33) + i) for i in range(500)]
    df = spark.createDataFrame(rows, "candidate boolean, line_no long")
    for most in (0, 1, 5, 100, 600, 2**31 - 1, 10**12):
        limits = archive.Limits(max_observations=most)
        got = {tuple(r) for r in archive.within_quotas(df, limits).filter("retained").collect()}
        want = {(c, n, True) for c, quota in ((True, limits.candidates), (False, limits.background)) for n in sorted(n for x, n in rows if x == c)[:quota]}
        assert got == want, most
    assert archive.within_quotas(df.filter(F.col("candidate")), archive.Limits(max_observations=5)).filter("retained").count() == 4


def test_medians_equal_the_aggregate(spark):
    draw = random.Random(8)
    df = spark.createDataFrame([(g, draw.choice([0, 5, None, draw.randrange(10**9)])) for g in "abcc" for _ in range(draw.choice([1, 8, 75]))] + [("none", None)], "g string, v long")
    got = {r["g"]: (r["low"] + r["high"]) / 2 for r in medians(df, ["g"], "v").collect()}
    assert got == {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).filter("m IS NOT NULL").collect()}


def test_large_clusters_have_the_same_medians(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(f"c{k % 3}", f"a{draw.randrange(3)}", [("marker:task", f"t{draw.randrange(2)}")], None, draw.randrange(10**7) if k % 3 else 3_000_000 * k, k, f"e{k}") for k in range(120)]
    c = spark.createDataFrame(rows, "cluster_id string, actor_raw string, artifacts array<struct<kind:string,value:string>>, parent_key string, us long, ingest_ord long, event_key string")
    read = lambda: sorted((r["cluster_id"], r["name"], r["score"], tuple(r["evidence"])) for found in (detectors.handoffs(c), detectors.periodicity(c)) for r in found.collect())
    plain = read()
    assert len(plain) >= 4
    for few in (0, 39):
        monkeypatch.setattr(detectors, "MEDIAN_ROWS", few)
        assert read() == plain
