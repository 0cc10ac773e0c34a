"""Values by their rank within groups, exactly and for all groups at once.

Each pass counts the next digit of the values that share the digits found so far, so that a rank is known to lie in one
digit of 2,048; nothing is sorted or gathered, and no buffer grows with a group or with a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import written

DIGIT_BITS = 11


def _without_low(value: Column, bits: int) -> Column:
    return F.shiftright(value, bits) if bits < 63 else F.lit(0).cast("long")


def ordinals(rows: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by..., k, value) for each (by..., k) of ``wanted``: the value of rank k, from 0, among the group's rows.

    ``value`` is a long of 0 or more; rows without one do not count. The columns ``by`` hold no null. A rank that the group
    does not have gives no row. ``rows`` are read once for each digit of the largest value, so they should be at rest.
    """
    rows = rows.filter(F.col(value).isNotNull())
    most = rows.agg(F.max(value)).first()[0]
    shift = -(-max(1, (most or 0).bit_length()) // DIGIT_BITS) * DIGIT_BITS
    found = wanted.select(*by, "k", F.lit(0).cast("long").alias("prefix_"), F.col("k").cast("long").alias("left_"))
    while shift:
        known = _without_low(F.col(value), shift)
        shift -= DIGIT_BITS
        digits = rows.select(*by, known.alias("prefix_"), _without_low(F.col(value), shift).alias("digit_"))
        counts = digits.join(found.select(*by, "prefix_").distinct(), [*by, "prefix_"], "left_semi").groupBy(*by, "prefix_", "digit_").agg(F.count("*").alias("n_"))
        up_to = F.sum("n_").over(Window.partitionBy(*by, "prefix_").orderBy("digit_").rowsBetween(Window.unboundedPreceding, 0))
        ends = counts.withColumn("end_", up_to)
        inside = (F.col("left_") < F.col("end_")) & (F.col("left_") >= F.col("end_") - F.col("n_"))
        found = found.join(ends, [*by, "prefix_"]).filter(inside).select(*by, "k", F.col("digit_").alias("prefix_"), (F.col("left_") - F.col("end_") + F.col("n_")).alias("left_"))
        found = written(found, "ordinals")
    return found.select(*by, "k", F.col("prefix_").alias(value))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., low, high): the two middle values of each group, which are one where the group's number of values is odd."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("k")
    found = ordinals(rows, by, value, written(n.select(*by, middle), "middles"))
    return found.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
