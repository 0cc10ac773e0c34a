"""Digests of sorted groups against plain Python, over groups that span batches and share tasks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.catalog import detection
from skein.operators.digests import line_digests


def test_groups_are_digested_in_order(spark, monkeypatch):
    rows = [(f"g{i % 3}" if i % 7 else None, i * 37 % 101, None if i % 11 == 0 else f"v{i}") for i in range(1000)] + [("none", 1, None)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["g"]: (r["n"], r["digest"]) for r in line_digests(spark.createDataFrame(rows, "g string, o int, v string"), "g", ["o", "v"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((o, v is not None, v or "") for x, o, v in rows if x == g)
        want[g] = (len(own), hashlib.sha256("\n".join(v for _, there, v in own if there).encode()).hexdigest())
    assert got == want


@pytest.fixture(scope="module")
def weeks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("weeks"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).cast("timestamp_ntz")
    spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 13 + 1).alias("user_id"), at.alias("ts"), F.lit(0.5).alias("value")).write.parquet(f"{path}/events.parquet")
    return path


def test_no_row_holds_a_weeks_keys(spark, weeks):
    import duckdb

    out = detection.QUERIES["detect_shift_coverage"](spark, weeks)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{weeks}/events.parquet/*.parquet')")
    want = db.execute(detection.ORACLES["detect_shift_coverage"])
    cols = [c[0] for c in want.description]
    got = sorted(tuple(r) for r in out.select(*cols).collect())
    assert got == sorted(want.fetchall()) and len(got) >= 3 and min(r[cols.index("ids")] for r in got) > 300
