"""Connected components of an edge table by alternating large and small stars, wholly in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b) but the least of its component, c.

    Each round's edges are a table in the shared folder. The rounds end when a round changes no edge; their number
    grows with the logarithm of the longest path. Loops and repeated edges do no harm; no edges give no rows.
    """

    def state(df: DataFrame) -> tuple[int, int | None]:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = written(_small(_large(now)), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("v"), F.col("b").alias("c"))
