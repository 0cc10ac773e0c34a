"""Digests of a group's values in an order, without the values in one row.

SHA-256 reads its text from the first byte to the last, so a group is read by one task; it is sorted beforehand, which spills,
and passes in batches, so that memory does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (group, value) that come sorted by group: (group, n, digest) once a group is over."""
    group, n, digest, apart = None, 0, None, b""

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"group": pa.array([group], pa.string()), "n": pa.array([n], pa.int32()), "digest": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        start = 0
        for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if digest is None or own != group:
                if digest is not None:
                    yield told()
                group, n, digest, apart = own, 0, hashlib.sha256(), b""
            said = [x for x in batch.column(1).slice(start, end - start).to_pylist() if x is not None]
            if said:
                digest.update(apart + "\n".join(said).encode())
                apart = b"\n"
            n += end - start
            start = end
    if digest is not None:
        yield told()


def line_digests(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, n, digest) of each group: how many rows it has, and the SHA-256 of its values in their order, a line each."""
    placed = rows.select(by, *order, value).repartition(by).sortWithinPartitions(by, *order).select(by, value)
    return placed.mapInArrow(_hashed, "group string, n int, digest string").withColumnRenamed("group", by)
