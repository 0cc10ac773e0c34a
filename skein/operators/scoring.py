"""From signals to a review priority: the best signal of each family, independent components, tiers and reasons."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How far a family's signals are trusted, and the families that can carry a finding alone.
RELIABILITY = {"protocol": 0.90, "temporal": 0.65, "artifact": 0.95, "graph": 0.70, "semantic": 1.00, "identity": 1.00, "behavior": 0.90, "commit": 0.85}
ANCHORS = ["artifact", "semantic", "identity", "behavior", "commit"]
FAMILY_FLOOR, STRONG_FAMILY, EXCEPTIONAL, VERIFIED_FLOOR = 0.35, 0.68, 0.82, 0.80
RANK_WEIGHTS = (0.52, 0.31, 0.17)

#: One row a signal; the last five columns are what scoring reads of a signal's metadata.
SIGNALS = (
    "cluster_id string, family string, name string, score double, detector_ord int, signal_ord long, observation_ids array<string>, evidence array<string>, "
    "evidence_groups array<string>, depends_on array<string>, longitudinal boolean, cross_resource boolean, exceptional boolean, verified_native int, verified_cross int"
)

#: What a score needs of a signal, and of an observation besides what detectors read.
SIGNAL_READS = ["cluster_id", "family", "name", "score", "detector_ord", "signal_ord", "depends_on", "longitudinal", "cross_resource", "exceptional", "verified_native", "verified_cross"]
FACT_READS = ["actor_raw", "provenance_url"]


@dataclass(frozen=True)
class CalibrationProfile:
    likelihood_ratios: dict[str, float] = field(default_factory=dict)
    prior_probability: float = 0.001
    exceptional_lr: float = 100.0
    corpus_id: str = "unknown"

    @classmethod
    def load(cls, path: str) -> CalibrationProfile:
        import json

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return cls({str(k): float(v) for k, v in given["likelihood_ratios"].items()}, float(given.get("prior_probability", 0.001)), float(given.get("exceptional_lr", 100.0)), str(given.get("corpus_id", "unknown")))


def best_of_family(signals: DataFrame) -> DataFrame:
    """A family's highest signal; of equal ones the first emitted."""
    rest = [c for c in signals.columns if c not in ("cluster_id", "family")]
    rank = F.struct("score", -F.col("detector_ord"), -F.col("signal_ord"))
    return signals.groupBy("cluster_id", "family").agg(F.max_by(F.struct(*rest), rank).alias("s")).select("cluster_id", "family", "s.*")


def cluster_facts(clustered: DataFrame) -> DataFrame:
    """What eligibility reads of a cluster's observations."""
    return clustered.groupBy("cluster_id").agg(
        F.count_distinct("actor_raw").cast("int").alias("actor_count"),
        F.count("*").cast("int").alias("observation_count"),
        F.bool_and(F.coalesce("provenance_url", F.lit("")) != "").alias("provenance_complete"),
    )


def _components(fired: Column) -> Column:
    """Families joined by their dependencies: array of arrays of indexes into ``fired``, by repeated least labels."""
    index = F.sequence(F.lit(0), F.size(fired) - 1)
    start = F.when(F.size(fired) > 0, index).otherwise(F.array().cast("array<int>"))

    def linked(i: Column, j: Column) -> Column:
        a, b = F.get(fired, i), F.get(fired, j)
        return (i == j) | F.array_contains(a["depends_on"], b["family"]) | F.array_contains(b["depends_on"], a["family"])

    def spread(label: Column) -> Column:
        return F.transform(label, lambda own, i: F.array_min(F.transform(F.filter(index, lambda j: linked(i, j)), lambda j: F.get(label, j))))

    # A dependency chain over the eight scored families has at most seven links.
    label = start
    for _ in range(len(RELIABILITY) - 1):
        label = F.transform(F.array(label), spread)[0]
    return label


def score(signals: DataFrame, facts: DataFrame, threshold: float = 0.60, calibration: CalibrationProfile | None = None) -> DataFrame:
    """One row for each cluster of ``facts``: score, families, tier, decision and reasons."""
    chosen = best_of_family(signals)
    per = chosen.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("family", "name", "score", "depends_on", "longitudinal", "cross_resource", "exceptional", "verified_native", "verified_cross"))).alias("sel"))
    df = facts.join(per, "cluster_id", "left").withColumn("sel", F.coalesce("sel", F.array().cast(per.schema["sel"].dataType)))
    trust = F.create_map(*[F.lit(x) for pair in RELIABILITY.items() for x in pair])
    floor = F.filter("sel", lambda s: s["family"].isin(list(RELIABILITY)) & (s["score"] >= FAMILY_FLOOR))
    df = df.withColumn("fired", F.transform(floor, lambda s: F.struct(s["family"].alias("family"), (trust[s["family"]] * s["score"]).alias("eff"), s["depends_on"].alias("depends_on"), s["exceptional"].alias("exceptional"))))
    df = df.withColumn("label", _components(F.col("fired"))).withColumn("_g", F.arrays_zip("fired", "label"))
    groups = F.transform(F.array_distinct("label"), lambda k: F.transform(F.filter("_g", lambda g: g["label"] == k), lambda g: g["fired"]))
    df = df.withColumn("groups", groups)
    df = df.withColumn("strengths", F.reverse(F.array_sort(F.transform("groups", lambda g: F.array_max(F.transform(g, lambda x: x["eff"]))))))
    rank = [F.coalesce(F.get("strengths", F.lit(i)), F.lit(0.0)) for i in range(3)]
    n = F.size("strengths")
    collapsed = F.size("fired") - n
    positive = F.lit(RANK_WEIGHTS[0]) * rank[0] + F.lit(RANK_WEIGHTS[1]) * rank[1] + F.lit(RANK_WEIGHTS[2]) * rank[2]
    positive = positive + F.when(n >= 2, 0.03).otherwise(0.0) + F.when(n >= 3, 0.03).otherwise(0.0) + F.least(F.lit(0.06), 0.03 * collapsed)
    semantic = F.get(F.filter("sel", lambda s: s["family"] == "semantic"), 0)
    has_artifact = F.exists("fired", lambda x: x["family"] == "artifact")
    verified = (semantic["name"] == "linked_coordination_exchange") & (semantic["score"] >= 0.90) & ((F.coalesce(semantic["verified_native"], F.lit(0)) > 0) | ((F.coalesce(semantic["verified_cross"], F.lit(0)) > 0) & has_artifact))
    strong_exception = F.filter("fired", lambda x: F.coalesce(x["exceptional"], F.lit(False)) & (x["eff"] >= EXCEPTIONAL))
    df = df.withColumns(
        {
            "collapsed": collapsed,
            "_positive": positive,
            "verified": F.coalesce(verified, F.lit(False)),
            "exceptional_strength": F.coalesce(F.array_max(F.transform(strong_exception, lambda x: x["eff"])), F.lit(0.0)),
            "benign": F.coalesce(F.get(F.filter("sel", lambda s: s["family"] == "benign"), 0)["score"], F.lit(0.0)),
        }
    )
    lr = F.create_map(*[F.lit(x) for pair in sorted((calibration.likelihood_ratios if calibration else {"": 0.0}).items()) for x in pair])
    known = F.filter(F.transform(F.filter("sel", lambda s: s["family"] != "benign"), lambda s: F.struct(s["name"].alias("name"), lr[s["name"]].alias("lr"))), lambda x: F.coalesce(x["lr"], F.lit(0.0)) > 0)
    df = df.withColumn("lrs", F.array_sort(F.array_distinct(known)))
    if calibration:
        log = F.aggregate("lrs", F.lit(0.0), lambda t, x: t + F.log(x["lr"]))
        prior = calibration.prior_probability / (1.0 - calibration.prior_probability)
        odds = F.lit(prior) * F.exp(F.least(F.col("evidence_log_likelihood_ratio"), F.lit(700.0)))
        df = df.withColumn("evidence_log_likelihood_ratio", log).withColumn("posterior_probability", odds / (1.0 + odds))
        unusual = F.exists("sel", lambda s: F.coalesce(lr[s["name"]], F.lit(0.0)) >= calibration.exceptional_lr)
    else:
        df = df.withColumns({"evidence_log_likelihood_ratio": F.lit(None).cast("double"), "posterior_probability": F.lit(None).cast("double")})
        unusual = F.lit(False)
    df = df.withColumn("calibrated_exceptional", unusual)
    exceptional = (F.col("exceptional_strength") > 0) | F.col("calibrated_exceptional")
    lifted = F.greatest(
        F.col("_positive"),
        F.col("exceptional_strength"),
        F.when(F.col("calibrated_exceptional"), F.coalesce("posterior_probability", F.lit(0.0))).otherwise(F.lit(0.0)),
        F.when(F.col("verified"), F.lit(VERIFIED_FLOOR)).otherwise(F.lit(0.0)),
    )
    anchor = F.filter("groups", lambda g: F.exists(g, lambda x: x["family"].isin(ANCHORS)))
    strong = F.filter("groups", lambda g: F.exists(g, lambda x: x["family"].isin(ANCHORS) & (x["eff"] >= STRONG_FAMILY)))
    lone = F.exists("sel", lambda s: F.coalesce(s["longitudinal"], F.lit(False)) & F.coalesce(s["cross_resource"], F.lit(False)))
    df = df.withColumns(
        {
            "total": F.greatest(F.lit(0.0), F.least(F.lit(1.0), lifted * (1.0 - 0.65 * F.col("benign")))),
            "anchors": F.size(anchor),
            "strong_anchors": F.size(strong),
            "component_count": n,
            "exceptional": exceptional,
            "eligible": ((F.col("actor_count") >= 2) | lone) & F.col("provenance_complete") & (F.col("benign") < 0.80),
        }
    )
    df = df.withColumn("reviewable", (F.col("total") >= threshold) & ((F.col("strong_anchors") >= 2) | F.col("verified") | F.col("exceptional")) & F.col("eligible"))
    corroborated = ((F.col("strong_anchors") >= 1) & ((F.col("component_count") >= 2) | (F.col("collapsed") > 0))) | (F.col("anchors") >= 2)
    df = df.withColumn("_medium", ~F.col("reviewable") & F.col("eligible") & (F.col("total") >= max(0.45, threshold - 0.25)) & corroborated)
    df = df.withColumn("confidence", F.when(F.col("reviewable"), "high").when(F.col("_medium"), "medium").otherwise("low"))
    decision = F.when(F.col("reviewable") & (F.col("strong_anchors") >= 3), "confirmed").when(F.col("reviewable"), "review").when(F.col("_medium"), "watch").otherwise("dismiss")
    df = df.withColumn("decision", decision).withColumn("families", F.map_from_entries(F.transform("sel", lambda s: F.struct(s["family"], s["score"]))))
    two = lambda c: F.format_string("%.2f", c)
    reasons = F.concat(
        F.transform(F.filter("sel", lambda s: s["score"] >= FAMILY_FLOOR), lambda s: F.concat(s["family"], F.lit("="), two(s["score"]))),
        F.array_compact(
            F.array(
                F.when(F.col("benign") > 0, F.concat(F.lit("benign_multiplier="), two(1.0 - 0.65 * F.col("benign")))),
                F.concat(F.lit("confidence="), "confidence"),
                F.when(F.col("collapsed") > 0, F.concat(F.lit("correlated_families_collapsed="), F.col("collapsed").cast("string"))),
                F.when(F.col("verified"), "route=verified_relational_exchange").when(F.col("exceptional"), "route=exceptional_single_signal").when(F.col("strong_anchors") >= 2, "route=two_independent_strong_anchors").when(F.col("_medium"), "route=analyst_watchlist"),
                F.when(~F.col("verified") & F.col("exceptional"), F.concat(F.lit("exceptional_strength="), two(F.col("exceptional_strength")))),
                F.when(~F.col("provenance_complete"), F.lit("provenance_incomplete")),
            )
        ),
        F.transform("lrs", lambda x: F.concat(F.lit("lr:"), x["name"], F.lit("="), two(x["lr"]))),
        F.array_compact(F.array(F.when(F.col("calibrated_exceptional"), F.lit("calibrated_exceptional_lr")))),
    )
    return df.select(
        "cluster_id",
        F.col("total").alias("raw_score"),
        F.round("total", 4).alias("score"),
        "families",
        "confidence",
        "reviewable",
        "actor_count",
        "observation_count",
        reasons.alias("reasons"),
        "decision",
        F.round("evidence_log_likelihood_ratio", 4).alias("evidence_log_likelihood_ratio"),
        F.round("posterior_probability", 8).alias("posterior_probability"),
    )


def fit_likelihood_ratios(cases: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(name, likelihood_ratio) from (case_id, label, names): how much likelier a signal is in positive scenarios."""
    totals = cases.agg(F.count_if(F.col("label") == "pos").alias("pos"), F.count_if(F.col("label") != "pos").alias("neg")).first()
    if not totals["pos"] or not totals["neg"]:
        raise ValueError("calibration requires positive and negative scenarios")
    seen = cases.select("label", F.explode(F.array_distinct("names")).alias("name")).groupBy("name").agg(F.count_if(F.col("label") == "pos").alias("p"), F.count_if(F.col("label") != "pos").alias("q"))
    in_pos = (F.col("p") + smoothing) / (totals["pos"] + 2 * smoothing)
    in_neg = (F.col("q") + smoothing) / (totals["neg"] + 2 * smoothing)
    return seen.select("name", (in_pos / in_neg).alias("likelihood_ratio"))


def posterior(log_lr: float, prior: float) -> float:
    odds = prior / (1 - prior) * math.exp(min(log_lr, 700.0))
    return odds / (1 + odds)


def confusion(rows: DataFrame, truth: str, flagged: str) -> DataFrame:
    """Counts and rates of a flag against the truth; a rate without cases is null."""
    t, f = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(flagged), F.lit(False))
    out = rows.agg(F.count_if(t & f).alias("true_positives"), F.count_if(t & ~f).alias("false_negatives"), F.count_if(~t & f).alias("false_positives"), F.count_if(~t & ~f).alias("true_negatives"))
    return out.withColumns({"recall": F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives")), "false_positive_rate": F.try_divide(F.col("false_positives"), F.col("false_positives") + F.col("true_negatives"))})


def empty_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SIGNALS)
