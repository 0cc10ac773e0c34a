"""The scorer on given signals: published values and routes."""

from __future__ import annotations

import pytest

from skein.operators import scoring


def signal(family, score, name=None, depends=(), n=0, **flags):
    given = {"longitudinal": False, "cross_resource": False, "exceptional": False, "verified_native": 0, "verified_cross": 0} | flags
    return ("c", family, name or family, score, 1, n, [], [], [], list(depends), *given.values())


def run(spark, *signals, actors=2, provenance=True, **how):
    facts = spark.createDataFrame([("c", actors, 3, provenance)], "cluster_id string, actor_count int, observation_count int, provenance_complete boolean")
    return scoring.score(spark.createDataFrame(list(signals), scoring.SIGNALS), facts, **how).first()


def test_single_exceptional_artifact(spark):
    r = run(spark, signal("artifact", 0.92, exceptional=True))
    assert r["score"] == 0.874 and r["reviewable"] and "exceptional_strength=0.87" in r["reasons"] and "route=exceptional_single_signal" in r["reasons"]


def test_two_independent_anchors_are_high(spark):
    r = run(spark, signal("artifact", 0.98), signal("semantic", 0.95))
    assert r["confidence"] == "high" and r["raw_score"] == pytest.approx(0.8126, abs=1e-4)


def test_dependent_families_collapse(spark):
    r = run(spark, signal("artifact", 0.98), signal("semantic", 0.95, depends=["artifact"]))
    assert r["confidence"] == "medium" and r["raw_score"] == pytest.approx(0.524, abs=1e-3) and "correlated_families_collapsed=1" in r["reasons"]


def test_one_anchor_with_weak_company_is_medium(spark):
    r = run(spark, signal("artifact", 0.95), signal("temporal", 0.90), signal("graph", 0.85), signal("protocol", 0.80), threshold=0.5)
    assert r["confidence"] == "medium" and r["raw_score"] == pytest.approx(0.8537, abs=1e-4)


def test_chains_of_dependencies_are_one_component(spark):
    r = run(spark, signal("protocol", 0.9, depends=["temporal"]), signal("temporal", 0.9, depends=["graph"]), signal("graph", 0.9, depends=["semantic"]), signal("semantic", 0.9), signal("behavior", 0.9))
    assert "correlated_families_collapsed=3" in r["reasons"]


def test_a_better_plain_signal_hides_an_exceptional_one(spark):
    r = run(spark, signal("artifact", 0.95), signal("artifact", 0.92, exceptional=True, n=1))
    assert not r["reviewable"]
    first = run(spark, signal("artifact", 0.92, n=1), signal("artifact", 0.92, exceptional=True, n=0))
    assert first["reviewable"]


def test_actor_gate_and_longitudinal_exception(spark):
    strong = [signal("identity", 0.99), signal("artifact", 0.98)]
    assert not run(spark, *strong, actors=1)["reviewable"]
    assert run(spark, *strong, signal("behavior", 0.5, longitudinal=True, cross_resource=True), actors=1)["reviewable"]
    assert not run(spark, *strong, provenance=False)["reviewable"]
    assert not run(spark, *strong, signal("benign", 0.85))["reviewable"]


def test_no_signals(spark):
    r = run(spark)
    assert (r["score"], r["confidence"], r["decision"], r["reasons"]) == (0.0, "low", "dismiss", ["confidence=low"])


def test_calibration(spark, tmp_path):
    cases = spark.createDataFrame([("1", "pos", ["a", "b"]), ("2", "pos", ["a"]), ("3", "neg", ["b"]), ("4", "other", [])], "case_id string, label string, names array<string>")
    fitted = {r["name"]: r["likelihood_ratio"] for r in scoring.fit_likelihood_ratios(cases).collect()}
    assert fitted == {"a": pytest.approx((2.5 / 3) / (0.5 / 3)), "b": pytest.approx(1.0)}
    path = tmp_path / "profile.json"
    path.write_text('{"likelihood_ratios": {"artifact": 200, "semantic": 3}, "corpus_id": "t"}')
    r = run(spark, signal("artifact", 0.9), signal("semantic", 0.9), calibration=scoring.CalibrationProfile.load(str(path)))
    assert r["posterior_probability"] == pytest.approx(scoring.posterior(6.3969, 0.001), abs=1e-4) and r["evidence_log_likelihood_ratio"] == pytest.approx(6.3969, abs=1e-4)
    assert "lr:artifact=200.00" in r["reasons"] and "calibrated_exceptional_lr" in r["reasons"]
    with pytest.raises(ValueError):
        scoring.fit_likelihood_ratios(cases.filter("label = 'pos'"))


def test_confusion_without_cases_is_null(spark):
    r = scoring.confusion(spark.createDataFrame([(False, True)], "t boolean, f boolean"), "t", "f").first()
    assert (r["recall"], r["false_positive_rate"], r["false_positives"]) == (None, 1.0, 1)
