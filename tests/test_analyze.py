"""Clusters to tiers, with the published outcomes of small exchanges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators.features import with_features
from skein.plans.analyze import analyze, bundles, saved_bundles, summary
from tests.conftest import observation as ob


def exchange(**last) -> list[dict]:
    return [
        ob(1, "alice-agent", "Please run the build. task_id=alpha-7781", 0, reply_to=None),
        ob(2, "bob-agent", "ACK task_id=alpha-7781", 20, **last.get("ack", {})),
        ob(3, "bob-agent", "Task complete, returning result: task_id=alpha-7781", 40, **last.get("done", {})),
    ]


def one(a):
    rows = a.scores.collect()
    assert len(rows) == 1
    return rows[0]


def test_delegation_without_replies_is_medium(observations):
    row = one(analyze(observations(exchange()), threshold=0.75))
    assert row["confidence"] == "medium" and row["decision"] == "watch" and not row["reviewable"]
    assert row["raw_score"] == pytest.approx(0.6688, abs=1e-4)


def test_native_replies_make_it_reviewable(observations):
    a = analyze(observations(exchange(ack={"reply_to": "1"}, done={"reply_to": "2"})), threshold=0.75)
    row = one(a)
    assert row["reviewable"] and row["confidence"] == "high"
    assert row["raw_score"] == pytest.approx(0.8561, abs=1e-4)
    assert "route=verified_relational_exchange" in row["reasons"]
    semantic = a.signals.filter("name = 'linked_coordination_exchange'").first()
    assert semantic["verified_native"] == 1 and semantic["depends_on"] == []
    assert semantic["observation_ids"] == ["jsonl:event:jsonl:1", "jsonl:event:jsonl:2", "jsonl:event:jsonl:3"]


def test_cross_platform_exchange_uses_the_verified_route(observations):
    rows = exchange()
    rows[1] |= {"source": "reddit", "repository": "reddit/r/tools", "thread_id": "t"}
    rows[2] |= {"source": "reddit", "repository": "reddit/r/tools", "thread_id": "t"}
    a = analyze(observations(rows), threshold=0.75)
    row = one(a)
    assert row["cluster_id"].startswith("linked:") and row["reviewable"]


def test_same_handle_on_two_platforms_is_one_actor(observations):
    rows = exchange()
    for r in rows:
        r["actor"] = "same"
    rows[2] |= {"source": "reddit", "repository": "reddit/r/tools"}
    assert not any(r["reviewable"] for r in analyze(observations(rows)).scores.collect())


def test_negated_act_makes_no_exchange(observations):
    rows = exchange()
    rows[0]["text"] = "Do not delegate this. task_id=alpha-7781"
    a = analyze(observations(rows))
    assert a.signals.filter("family = 'semantic'").count() == 0


def test_opaque_payloads_between_two_actors(observations):
    import base64
    import hashlib

    rows = [ob(i, "ab"[i % 2] + "-agent", base64.b64encode(hashlib.sha256(str(i).encode()).digest() + b"xyz").decode(), 30 * i) for i in range(6)]
    a = analyze(observations(rows))
    signal = a.signals.filter("name = 'opaque_cross_actor_exchange'").first()
    assert signal["score"] == pytest.approx(0.99) and signal["exceptional"]
    assert one(a)["reviewable"]


def test_missing_provenance_is_not_eligible(observations):
    rows = exchange(ack={"reply_to": "1"}, done={"reply_to": "2"})
    rows[1]["provenance"] = {"url": ""}
    row = one(analyze(observations(rows)))
    assert not row["reviewable"] and "provenance_incomplete" in row["reasons"]


def test_routine_automation_is_penalised(observations):
    rows = [ob(i, "renovate[bot]", "Bump dependency left-pad; generated by automation", 30 * i, metadata={"actor_type": "Bot"}) for i in range(2)]
    signal = analyze(observations(rows)).signals.filter("family = 'benign'").first()
    assert signal["score"] == pytest.approx(0.15 + 0.75 + 0.10)


def test_export_keeps_time_order_and_text(observations):
    obs = observations(exchange())
    a = analyze(obs)
    row = bundles(a, obs).first()
    assert [o["event_key"][-1] for o in row["observations"]] == ["1", "2", "3"] and row["actors"] == ["alice-agent", "bob-agent"]
    assert saved_bundles(a.scores).count() == 1
    assert summary(a.scores)["clusters"] == 1


def test_an_empty_table_gives_empty_results(spark, observations):
    obs = observations(exchange()).filter("false")
    assert with_features(obs).count() == 0
    a = analyze(obs)
    assert a.signals.count() == 0 and a.scores.count() == 0


def test_long_trajectories_are_clusters_of_their_own(observations):
    rows = [ob(i, "night-owl", f"working on the same objective {i % 2}", 4 * 3600 * i, repository=f"acme/r{i % 3}", thread_id=str(i)) for i in range(14)]
    a = analyze(observations(rows))
    found = a.signals.filter("family = 'behavior'").collect()
    assert [s["name"] for s in found] == ["round_the_clock_objective_persistence"]
    assert found[0]["cluster_id"].startswith("trajectory:actor:") and found[0]["cross_resource"]


def test_leader_and_workers(observations):
    rows, n = [], 0
    for worker in ("w1", "w2", "w3"):
        for _ in range(2):
            rows += [ob(n, "lead", f"step {n}", 10 * n), ob(n + 1, worker, "noted", 10 * n + 5, reply_to=str(n))]
            n += 2
    a = analyze(observations(rows))
    names = {r["name"]: r["score"] for r in a.signals.filter("family = 'graph'").collect()}
    assert names["coordination_topology"] == pytest.approx(0.35 * 0.75)
    assert names["repeated_leader_worker_aggregation"] == pytest.approx(0.68 + 0.12 + 0.09)


def test_commit_patterns(observations):
    rows = []
    for i in range(9):
        rows.append(ob(i, f"dev{i % 3}", None, 600 * i, event_type="PushEvent", thread_id=None, metadata={"commit_messages": [f"Update file {i}"], "author_email_domains": ["users.noreply.github.com"]}))
    names = {r["name"]: r["score"] for r in analyze(observations(rows), minutes=1440).signals.filter("family = 'commit'").collect()}
    assert names == {"machine_exact_commit_intervals": pytest.approx(0.90), "uniform_commit_message_template": pytest.approx(0.88), "shared_generated_author_domain": pytest.approx(0.77)}


def test_ancestry_stops_at_sixteen_and_at_cycles(spark):
    from skein.operators.detectors import ancestors

    chain = [("c", str(i), str(i - 1) if i else None) for i in range(20)]
    loop = [("d", "a", "b"), ("d", "b", "a"), ("d", "x", "gone"), ("d", "y", "a")]
    got = {(r["cluster_id"], r["event_key"]): r["ancestors"] for r in ancestors(spark.createDataFrame(chain + loop, "cluster_id string, event_key string, parent_key string")).collect()}
    assert got["c", "19"] == [str(i) for i in range(18, 2, -1)] and got["c", "3"] == ["2", "1", "0"] and ("c", "0") not in got
    assert got["d", "a"] == ["b", "a"] and got["d", "y"] == ["a", "b"] and ("d", "x") not in got


def test_scores_alone_are_those_of_the_analysis(spark, tmp_path, monkeypatch):
    from skein.catalog.synthetic import observations as made
    from skein.plans import analyze as plan

    at = F.timestamp_seconds(F.lit(1_704_069_000) + F.col("id") * 120).cast("timestamp_ntz")
    spark.range(2000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 23).alias("user_id"), at.alias("ts"), F.lit(0.5).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    obs = made(spark, str(tmp_path)).drop("cluster_id", "th")
    want = {r["cluster_id"]: r for r in analyze(obs).scores.collect()}
    columns = {}
    keep = plan.written
    monkeypatch.setattr(plan, "written", lambda df, name: columns.update({name: set(df.columns)}) or keep(df, name))
    assert {r["cluster_id"]: r for r in plan.scores_alone(obs).collect()} == want and len(want) > 50
    assert "content_sha256" not in columns["features"] and not {"url", "scaffold"} & columns["clustered"] and "observation_ids" not in columns["signals"]
