"""Paths of an exchange counted without a list of them, against the list."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import detectors

SCHEMA = "cluster_id string, event_key string, parent_key string, us long, ingest_ord long, actor_raw string, conversation_key string, resource_key string, acts array<string>, refs array<string>"
ACTS = ["ack", "delegation", "result", "state_in", "state_out"]


def _clusters(seed: int, clusters: int = 12, rows: int = 40):
    """Rows with several acts and references, ties of time, replies back and forth, some of them in a ring."""
    draw = random.Random(seed)
    out = []
    for k in range(clusters):
        names = [f"{k}-{i}" for i in range(rows)]
        for i, name in enumerate(names):
            parent = draw.choice([None, None, names[max(0, i - 1)], draw.choice(names), "elsewhere"])
            acts = sorted(draw.sample(ACTS, draw.choice([0, 1, 1, 2])))
            refs = sorted(draw.sample(["a", "b", "c", name], draw.choice([0, 1, 1, 2, 3])))
            out.append((f"c{k}", name, parent, draw.randrange(rows), draw.randrange(5), draw.choice(["x", "x", "y", "z", None]), None, "r", acts, refs))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_are_those_of_the_list(spark, seed):
    c = spark.createDataFrame(_clusters(seed), SCHEMA).localCheckpoint()
    told = F.filter("evidence", lambda e: ~e.startswith("verified_cross")).alias("evidence")
    cols = ["cluster_id", "score", "observation_ids", told, "depends_on", "verified_native"]
    want = detectors.exchange(c, occurrences=None, most=None).select(*cols).orderBy("cluster_id").collect()
    got = detectors.exchange_totals(c).select(*cols).orderBy("cluster_id").collect()
    assert len(want) == 12 and got == want


def test_a_crowd_of_paths_is_not_listed(spark, monkeypatch):
    """3,000 delegations and as many results make nine million paths; what is written has as many rows as there are events."""
    n = 6000
    acts = F.when(F.col("id") < n // 2, F.array(F.lit("delegation"))).otherwise(F.array(F.lit("result")))
    c = spark.range(n).select(F.lit("c").alias("cluster_id"), F.col("id").cast("string").alias("event_key"), F.lit(None).cast("string").alias("parent_key"), F.col("id").alias("us"), F.col("id").alias("ingest_ord"), (F.col("id") % 2 + F.col("id").cast("int") * 2 % 7).cast("string").alias("actor_raw"), F.lit("v").alias("conversation_key"), F.lit("r").alias("resource_key"), acts.alias("acts"), F.array(F.lit("ref")).alias("refs"))
    sizes = []
    keep = detectors.written
    monkeypatch.setattr(detectors, "written", lambda df, name: sizes.append((kept := keep(df, name)).count()) or kept)
    row = detectors.exchange_totals(c).first()
    actors = [str(i % 2 + i * 2 % 7) for i in range(n)]
    left, right = ({a: half.count(a) for a in half} for half in (actors[: n // 2], actors[n // 2 :]))
    paths = sum(k * m for a, k in left.items() for b, m in right.items() if a != b)
    assert paths > 7_000_000 and f"paths={paths}" in row["evidence"] and len(row["observation_ids"]) == n
    assert max(sizes) <= n
