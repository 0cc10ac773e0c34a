"""Exact ranks within groups by histograms of the digits of a sort key, without a global sort.

Rows are counted by the first digits of their key. A digit's rank begins after all rows of smaller digits under the same
prefix, of which there are at most DIGIT_VALUES. Prefixes that hold more than BUCKET_ROWS rows are counted by their next
digits, and so on; only the rows of one bucket are ever sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import written

#: Characters of a digit. Keys are hexadecimal, so a digit has 4,096 values.
DIGIT = 3
#: Rows of a bucket, which one task sorts.
BUCKET_ROWS = 10_000


def long_key(value: Column) -> Column:
    """16 hexadecimal digits that ascend as the signed ``value`` does."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def nulls_first(key: Column) -> Column:
    return F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), key))


def _common(rows: DataFrame, key: str) -> int:
    """The number of characters that all keys share at their start."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    at = 0
    while lo is not None and at < min(len(lo), len(hi)) and lo[at] == hi[at]:
        at += 1
    return at


def ranked(rows: DataFrame, by: list[str], key: str, digit: int = DIGIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (at rest) with ``rank`` (from 0, by ``key`` within the columns ``by``, which hold no null) and ``n``, the
    group's number of rows. Keys must differ within a group for ranks to be a function of the rows."""
    size, pending, done = _common(rows, key) + digit, rows.withColumns({"parent_": F.lit(""), "below_": F.lit(0).cast("long")}), []
    while True:
        pending = pending.withColumn("bucket_", F.substring(key, 1, size))
        counts = pending.groupBy(*by, "parent_", "bucket_").agg(F.count("*").alias("in_"), F.first("below_").alias("below_"))
        within = Window.partitionBy(*by, "parent_")
        before = F.sum("in_").over(within.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumns({"start_": F.col("below_") + F.coalesce(before, F.lit(0)), "n_": F.sum("in_").over(within)}).drop("below_", "parent_")
        counts = written(counts, "digits")
        placed = pending.drop("below_", *(["n_"] if done else [])).join(counts, [*by, "bucket_"])
        if not done:
            placed = placed.withColumn("n", F.col("n_"))
        placed = written(placed.drop("n_", "parent_"), "placed")
        done.append(placed.filter(F.col("in_") <= bucket_rows))
        if counts.filter(F.col("in_") > bucket_rows).isEmpty():
            break
        pending = placed.filter(F.col("in_") > bucket_rows).withColumnRenamed("bucket_", "parent_").withColumnRenamed("start_", "below_").drop("in_")
        size += digit
    place = F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy(key))
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.col("start_") + place - 1).select(*rows.columns, "rank", "n")
