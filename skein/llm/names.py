"""Columns of a caller beside columns of an operator. Spark compares names without case, and so does this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns renamed by place, so that none can clash, and the new name of each old one.

    ``.toDF(*df.columns)`` on the same columns gives the old names back.
    """
    names = [f"own_{i}_" for i in range(len(df.columns))]

    def of(name: str) -> str:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name} among {df.columns}")
        return names[same[0]]

    return df.toDF(*names), of


def chosen(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``, whatever others it has."""
    plain, of = numbered(df)
    return plain.select(*[F.col(of(n)).alias(n) for n in names])


def with_results(df: DataFrame, results: list[str], last: list[str]) -> DataFrame:
    """The columns of ``last`` under the names ``results`` after all others of ``df``; of the others, one that bears a
    result's name gets ``own_`` before it, as often as it takes."""
    others = [c for c in df.columns if c not in last]
    taken = {c.lower() for c in others} | {r.lower() for r in results}
    named = []
    for name in others:
        new = name
        if name.lower() in {r.lower() for r in results}:
            while new.lower() in taken:
                new = "own_" + new
            taken.add(new.lower())
        named.append(new)
    return df.select(*others, *last).toDF(*named, *results)
