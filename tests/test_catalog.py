"""Queries of the catalog against plain Python: every row takes part."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.catalog import detection, operations


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 20).alias("user_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") * 0.5).alias("value")).write.parquet(f"{path}/events.parquet")
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("aa").alias("lang")).write.parquet(f"{path}/documents.parquet")
    spark.range(0, 50, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def test_every_document_is_an_alert(spark, tables):
    got = {r["id"]: r["quality"] for r in operations.alert_reviews(spark, tables).collect()}
    assert got == {i: None if i % 3 else i % 2 for i in range(50)}


def test_odd_events_of_every_user_are_new(spark, tables):
    events = [(i * 7 % 20, i) for i in range(400)]
    want = {f"u{u}": max(((i % 2, i) for v, i in events if v == u))[1] for u in range(20)}
    assert {r["key"]: r["event_id"] for r in operations.upsert_latest(spark, tables).collect()} == want


def test_every_observation_gives_a_signal(spark, tables):
    signals = detection._signals(spark, tables)
    assert sorted(r["signal_ord"] for r in signals.collect()) == list(range(400))
    assert detection.score(spark, tables).count() == 34


def _against_sql(spark, path, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    want = db.execute(detection.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = detection.QUERIES[name](spark, path).select(*cols).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
    return got


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A thousand events of one half hour: 125 of each kind, far more than 500 paths."""
    path = str(tmp_path_factory.mktemp("crowded"))
    at = F.timestamp_seconds(F.lit(1_704_069_000) + F.col("id") * 1.5).cast("timestamp_ntz")
    spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 23).alias("user_id"), at.alias("ts"), F.lit(0.5).alias("value")).write.parquet(f"{path}/events.parquet")
    return path


def test_every_path_of_a_crowded_thread_counts(spark, crowded):
    assert _against_sql(spark, crowded, "detect_exchange")[0]["ids"] > 250


def test_queries_of_detectors_compute_only_what_is_read(spark, crowded, monkeypatch):
    kept = []
    monkeypatch.setattr(detection, "written", lambda df, name: kept.append(set(df.columns)) or df)
    detection.QUERIES["detect_shift_coverage"](spark, crowded)
    detection.QUERIES["isolated_acts"](spark, crowded)
    assert kept == [{"cluster_id", "event_key", "actor_key", "resource_key", "us", "ingest_ord", "is_bot"}, {"cluster_id", "event_key", "acts"}]


def test_only_results_among_the_first_paths_are_paired(spark, crowded, monkeypatch):
    from skein.catalog.synthetic import clustered
    from skein.operators import detectors

    kept = []
    keep = detectors._first_right
    monkeypatch.setattr(detectors, "_first_right", lambda right, *a: kept.append((right, keep(right, *a))) or kept[-1][1])
    c = clustered(spark, crowded, "'all'").select("cluster_id", *detectors.READS["exchange"])
    got = detectors.exchange(c, most=50).collect()
    assert [(a.count() > 100, 0 < b.count() < 50) for a, b in kept] == [(True, True), (True, True)]
    monkeypatch.setattr(detectors, "_first_right", lambda right, *a: right)
    assert got == detectors.exchange(c, most=50).collect() and len(got) == 1


def test_no_table_of_keys_is_sent_to_all_tasks(spark, crowded):
    """Broadcasts go through the driver; a table of every event's key must not, however small its files are."""
    c = detection.written(detection.clustered(spark, crowded), "features")
    edges = detection.detectors.graph_tables(c)[1].filter("relation IN ('reply_to', 'responded_to')")
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in detection.detectors.reply_edges(c)._jdf.queryExecution().executedPlan().toString()
    plans = []
    keep = detection.detectors.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(detection.detectors, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
        detection.detectors.ancestors(c.select("cluster_id", "event_key", "parent_key"))
    assert len(plans) >= 2 and not any("Broadcast" in p for p in plans)
