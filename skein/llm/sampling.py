"""Bounded samples by hash that stay small on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_cut(df: DataFrame, key: Column, rows: int) -> Column:
    """A condition that about four times ``rows`` rows of ``df`` meet (all, if there are fewer).

    Hashes are uniform, so the share of hash space that is let through is set by the number of rows. A ranking of what is
    left moves a number of rows that does not depend on the size of the table.
    """
    n = df.count()
    share = min(1.0, 4 * rows / max(n, 1))
    if share >= 1.0:
        return F.lit(True)
    return key < F.lit(int(-(2**63) + share * 2**64)).cast("long")


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: those of the smallest hashes. Other columns are read for these rows alone."""
    hashes = df.select(key.alias("_h"))
    cut = hash_cut(hashes, F.col("_h"), rows)
    last = hashes.filter(cut).orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    if last is None:
        return df.limit(0)
    return df.filter(key <= F.lit(last)).limit(rows)
