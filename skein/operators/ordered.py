"""Looking back in time within a group, without the group being the work of one task.

A group is ordered in parts of an hour each. What a part's first row has to know of earlier parts comes from a table with
one row for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a part.
PART = 3_600_000_000


def _with_earlier(rows: DataFrame, by: list[str], of_part: Column, earlier: Column, within: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` with ``_part`` and ``_before``: ``earlier`` over the values ``_v`` of the group's parts. Null is a group too."""
    rows = rows.withColumn("_part", F.floor(F.col("us") / PART))
    over = Window.partitionBy(*by).orderBy("_part")
    per = rows.groupBy(*by, "_part").agg(of_part.alias("_v")).withColumn("_before", earlier.over(over.rowsBetween(*within) if within else over))
    per = per.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    return rows.join(per, same & (F.col("_part") == F.col("_p"))).drop("_p", *[f"_by{i}" for i in range(len(by))])


def previous(rows: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """``rows`` (with us, the first of ``order``) with ``prev``: a struct of ``cols`` of the row before, null for the first."""
    own = F.struct(*cols)
    placed = _with_earlier(rows, by, F.max_by(own, F.struct(*order)), F.lag("_v"))
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    return placed.withColumn("prev", F.coalesce(F.lag(own).over(within), F.col("_before"))).drop("_part", "_before")


def runs(rows: DataFrame, by: list[str], order: list[str], gap: int, name: str) -> DataFrame:
    """``rows`` with ``name``, the number of times at or before the row that more than ``gap`` microseconds passed between
    neighbours of its group."""
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    apart = (F.col("us") - F.lag("us").over(within) > gap).cast("int")
    rows = rows.withColumn("_part", F.floor(F.col("us") / PART)).withColumn("_apart", F.coalesce(apart, F.lit(0)))
    # A part's first row is compared with the last of the part before it.
    over = Window.partitionBy(*by).orderBy("_part")
    per = rows.groupBy(*by, "_part").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"), F.sum("_apart").alias("_n"))
    per = per.withColumn("_first", F.coalesce((F.col("_lo") - F.lag("_hi").over(over) > gap).cast("int"), F.lit(0)))
    before = F.sum(F.col("_first") + F.col("_n")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    per = per.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    placed = rows.join(per, same & (F.col("_part") == F.col("_p"))).drop("_p", *[f"_by{i}" for i in range(len(by))])
    count = F.sum("_apart").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    return placed.withColumn(name, count.cast("int")).drop("_part", "_apart", "_before")


def counted(rows: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag`` (0 or 1) turned into the number of flagged rows at or before the row."""
    placed = _with_earlier(rows, by, F.sum(flag), F.sum("_v"), (Window.unboundedPreceding, -1))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(flag, (F.sum(flag).over(within) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_part", "_before")
