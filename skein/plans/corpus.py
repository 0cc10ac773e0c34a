"""Evaluation on a labelled corpus of scenarios: each scored alone, and found again in a run over everything."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import features, scoring
from skein.plans.analyze import analyze, analyze_members
from skein.scratch import written
from skein.sources.observations import read_corpus

LABELS = "id string, label string, scenario string, event_ids array<string>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        clusters = json.load(f).get("clusters", [])
    return spark.createDataFrame([(str(c["id"]), str(c["label"]), c.get("scenario"), list(c["event_ids"])) for c in clusters], LABELS)


def evaluate(observations: DataFrame, labels: DataFrame, threshold: float = 0.60) -> dict:
    """Counts, confusion of both runs, likelihood ratios and a row for each scenario.

    An event in two scenarios, or one that no observation has, is an error.
    """
    events = labels.select("id", F.explode("event_ids").alias("source_event_id"))
    twice = events.groupBy("source_event_id").agg(F.count_distinct("id").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"label leakage: events in several scenarios: {sorted(r[0] for r in twice)}")
    missing = events.join(observations.select("source_event_id"), "source_event_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing labeled observations: {sorted(r[0] for r in missing)}")
    feats = written(features.with_features(observations), "features")
    named = events.join(feats.select("source_event_id", "event_key"), "source_event_id")
    alone = analyze_members(feats, named.select(F.col("id").alias("cluster_id"), "event_key"), threshold)
    names = alone.signals.filter("family <> 'benign'").groupBy("cluster_id").agg(F.array_sort(F.collect_set("name")).alias("signals"))
    scores = alone.scores.select("cluster_id", "reviewable", "score", "confidence", "reasons")
    rows = labels.withColumnRenamed("id", "cluster_id").join(scores, "cluster_id", "left").join(names, "cluster_id", "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))
    together = analyze(observations, threshold)
    found = together.scores.filter("reviewable").select("cluster_id").join(together.clustered.select("cluster_id", "source_event_id"), "cluster_id")
    n_found = found.groupBy("cluster_id").agg(F.count_distinct("source_event_id").alias("n"))
    held = found.distinct().join(events, "source_event_id").groupBy("cluster_id", "id").agg(F.count("*").alias("inside")).join(n_found, "cluster_id")
    sizes = labels.select("id", F.size("event_ids").alias("expected"))
    hit = held.join(sizes, "id").filter("inside = n AND n >= least(2, expected)").select(F.col("id").alias("cluster_id"), F.lit(True).alias("end_to_end_reviewable")).distinct()
    rows = written(rows.join(hit, "cluster_id", "left").withColumn("end_to_end_reviewable", F.coalesce("end_to_end_reviewable", F.lit(False))).withColumn("positive", F.col("label") == "pos"), "scenarios")
    return {
        "counts": {"observations": observations.count(), "scenarios": rows.count(), "positive_scenarios": rows.filter("positive").count(), "control_scenarios": rows.filter("NOT positive").count()},
        "metrics": scoring.confusion(rows, "positive", "end_to_end_reviewable").first().asDict(),
        "oracle_cluster_metrics": scoring.confusion(rows, "positive", "reviewable").first().asDict(),
        "presence_likelihood_ratios": {r["name"]: r["likelihood_ratio"] for r in scoring.fit_likelihood_ratios(rows.select("label", F.col("signals").alias("names"))).collect()},
        "scenarios": [r.asDict() for r in rows.drop("event_ids", "positive").orderBy("cluster_id").collect()],
    }


def evaluate_files(spark: SparkSession, observations_path: str, labels_path: str, threshold: float = 0.60) -> dict:
    return evaluate(read_corpus(spark, observations_path), read_labels(spark, labels_path), threshold)
