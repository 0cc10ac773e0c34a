"""Readers: keys, validation, archives, threads, forums, snippets, queries, Parquet."""

from __future__ import annotations

import gzip
import json

import duckdb
import pytest

from skein.plans.analyze import analyze
from skein.plans.corpus import evaluate_files
from skein.sources import archive, feeds
from skein.sources.observations import read_corpus, read_jsonl, write_parquet
from tests.conftest import observation as ob


def test_keys_by_platform(observations):
    rows = [ob(1, "Al", source="GitHub-events", reply_to="0"), ob(2, "Al", source="reddit", thread_id=None), ob(3, "Al", source="x", metadata={"origin_source": "gharchive"}), ob(4, "Al", source="x", metadata={"campaign_source": "grep"}, event_key="own", repository=None)]
    got = {r["source_event_id"]: r for r in observations(rows).collect()}
    assert got["1"]["parent_key"] == "github:event:GitHub-events:0" and got["1"]["conversation_key"] == "github:repository:acme/widgets:thread:7"
    assert got["2"]["actor_key"] == "reddit:actor:al" and got["2"]["conversation_key"] is None
    assert got["3"]["platform"] == got["4"]["platform"] == "github" and got["4"]["event_key"] == "own" and got["4"]["resource_key"] is None


def test_bad_lines_stop_the_job(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps(ob(1, "a")) + "\n{broken\n")
    with pytest.raises(Exception):
        read_jsonl(spark, str(path)).collect()
    path.write_text(json.dumps({k: v for k, v in ob(1, "a").items() if k != "actor"}) + "\n")
    with pytest.raises(Exception, match="without actor"):
        read_jsonl(spark, str(path)).collect()
    path.write_text((json.dumps(ob(1, "a")) + "\n") * 2)
    with pytest.raises(ValueError, match="duplicate"):
        read_corpus(spark, str(path))


def event(i, kind, payload, **more):
    return {"id": str(i), "type": kind, "created_at": "2026-01-05T12:00:00Z", "public": True, "actor": {"login": f"user{i}", "type": "User"}, "repo": {"name": "acme/widgets"}, "payload": payload} | more


EVENTS = [
    event(1, "IssuesEvent", {"action": "opened", "issue": {"id": 9, "number": 4, "title": "delegate it", "body": "see https://x.org/a", "html_url": "https://github.com/i"}}),
    event(2, "IssueCommentEvent", {"issue": {"id": 9, "number": 4}, "comment": {"id": 5, "body": "heartbeat", "html_url": "https://github.com/c"}}),
    event(3, "PushEvent", {"commits": [{"sha": "s", "message": "checkpoint one", "url": "https://api/x", "author": {"email": "A@B.Example"}}, {"sha": "t", "message": "two", "author": {"email": "c@b.example"}}]}),
    event(4, "WatchEvent", {"action": "checkpoint"}),
    event(5, "CreateEvent", {"ref_type": "branch", "ref": "nonce-branch", "description": None}),
    event(6, "PullRequestEvent", {"pull_request": {"id": 1, "number": 7, "title": "plain", "body": "nothing", "html_url": "u"}}),
    event(7, "IssueCommentEvent", {"issue": {"id": 9, "number": 4}, "comment": {"id": 6, "body": "heartbeat again", "html_url": "https://github.com/d"}}, repo={"name": "other/repo"}),
]


def write_archive(path, lines):
    path.write_bytes(gzip.compress("".join(x + "\n" for x in lines).encode()))
    return str(path)


def test_archive_hour(spark, tmp_path):
    path = write_archive(tmp_path / "2026-01-05-12.json.gz", [json.dumps(e) for e in EVENTS] + ['{"id": "8", "type": "PushEvent", "checkpoint" broken', ""])
    rows, counters = archive.read_archive(spark, path, archive.Limits(sample_rate=0.0))
    got = {r["source_event_id"]: r for r in rows.collect()}
    assert set(got) == {"1", "2", "3", "5", "7"}
    assert got["1"]["text"] == "delegate it\nsee https://x.org/a" and got["1"]["thread_id"] == "4" and got["1"]["artifact_urls"] == ["https://x.org/a"]
    assert got["3"]["commit_messages"] == ["checkpoint one", "two"] and got["3"]["email_domains"] == ["b.example"] and got["3"]["provenance_url"] == "https://api/x"
    assert got["2"]["event_key"] == "github:event:gharchive:2" and got["5"]["provenance_url"] == "https://github.com/acme/widgets"
    assert counters["candidate_events"] == counters["observations"] == 5 and counters["malformed_events"] == 1 and counters["events_scanned"] == 8


def test_archive_quota_repositories_and_sampling(spark, tmp_path):
    path = write_archive(tmp_path / "a.json.gz", [json.dumps(e) for e in EVENTS])
    rows, counters = archive.read_archive(spark, path, archive.Limits(sample_rate=0.0, max_observations=3))
    assert [r["source_event_id"] for r in rows.orderBy("ingest_ord").collect()] == ["1", "2", "3"] and counters["dropped_candidate_events"] == 2
    rows, counters = archive.read_archive(spark, path, archive.Limits(sample_rate=1.0, repositories=("ACME/widgets",)))
    assert rows.count() == 5 and counters["repository_filtered_events"] == 1 and counters["sampled_observations"] == 1


def test_truncated_archive_is_an_error(spark, tmp_path):
    path = tmp_path / "b.json.gz"
    whole = gzip.compress("".join(json.dumps(e) + "\n" for e in EVENTS * 50).encode())
    path.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        archive.read_archive(spark, str(path))[0].count()


def test_hour_names():
    assert [archive.hour_name(h) for h in ("2026-01-05T09", "2026-01-05-23Z", "2026-01-05-0")] == ["2026-01-05-9", "2026-01-05-23", "2026-01-05-0"]
    with pytest.raises(ValueError):
        archive.hour_name("2026-01-05T24")


def test_review_threads_reach_the_verified_route(spark):
    user = lambda n: (n, "User")
    root = [(1, 5, "PR", "body", "2026-01-05T12:00:00Z", "https://api.github.com/repos/acme/widgets", "https://h/1", "open", user("author"), ("u",), [("bug",)], 3, "OWNER"), (2, 6, "no repo", "", None, "", "", "open", user("x"), None, None, None, None)]
    roots = spark.createDataFrame(root, feeds.ROOT)
    comment = lambda i, who, text, minute, parent: (i, text, f"2026-01-05T12:{minute:02d}:00Z", f"https://h/{i}", user(who), None, parent, "a.py", None, 1)
    review = spark.createDataFrame([comment(21, "lead", "Please run the migration", 1, None), comment(22, "worker", "ACK, starting task", 2, 21), comment(23, "worker", "task complete, returning the result", 3, 22)], feeds.COMMENT + ", root_id long")
    plain = spark.createDataFrame([comment(31, "other", "hello", 4, None)], feeds.COMMENT + ", root_id long")
    obs = feeds.thread_observations(roots, plain, review)
    assert obs.count() == 5
    scores = analyze(obs, threshold=0.75).scores.collect()
    assert [("route=verified_relational_exchange" in r["reasons"], r["reviewable"]) for r in scores] == [(True, True)]
    assert feeds.thread_observations(roots, plain, review, comments_per_thread=1).count() == 3


def test_forum_and_snippets(spark):
    posts = spark.createDataFrame([("p1", "tools", "ann", "1767614400", "About heartbeat", "text", 1, 2), ("p2", "tools", None, "1767614400", "other", "", 1, 2)], feeds.POST)
    comments = spark.createDataFrame([("c1", "tools", "bob", "1767614460.5", "reply", "t3_p1", "t3_p1", 1), ("c2", "tools", "bob", "1", "[deleted]", "t3_p1", "t1_c1", 1), ("c3", "tools", "bob", "1", "elsewhere", "t3_p2", "t3_p2", 1), ("c4", "tools", "eve", "1767614470", "more", "t3_p1", "t1_c1", 1)], feeds.POST_COMMENT)
    got = {r["source_event_id"]: r for r in feeds.forum_observations(posts, comments, '"Heartbeat" OR worker').collect()}
    assert set(got) == {"p1", "c1", "c4"} and got["c4"]["parent_key"] == "reddit:event:reddit:c1" and got["p1"]["text"] == "About heartbeat\n\ntext" and got["c1"]["conversation_key"] == "reddit:repository:reddit/r/tools:thread:p1"
    hit = feeds.snippet_observations(spark.createDataFrame([("Acme/W", "a.py", "<b>x</b> &lt; 1")], feeds.HIT)).first()
    assert hit["actor"] == "Acme" and hit["text"] == "Acme/W:a.py\nx < 1" and hit["provenance_url"] == "https://github.com/Acme/W/blob/HEAD/a.py"


def test_parquet_columns_read_back(observations, tmp_path):
    write_parquet(observations([ob(1, "a", "t")]), str(tmp_path / "out"))
    row = duckdb.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df()
    assert len(row) == 1 and len(row.columns) == 13 and row["event_key"][0] == "jsonl:event:jsonl:1"


def test_corpus_evaluation(spark, tmp_path):
    rows, labels = [], []
    for k in range(2):
        thread = {"repository": f"acme/r{k}", "thread_id": "1"}
        ids = [f"{k}{n}" for n in range(3)]
        rows += [ob(ids[0], "lead", f"Please run it. task_id=job-{k}aa9", 0, **thread), ob(ids[1], "hand", f"ACK task_id=job-{k}aa9", 9, reply_to=ids[0], **thread), ob(ids[2], "hand", f"task complete task_id=job-{k}aa9", 20, reply_to=ids[1], **thread)]
        labels.append({"id": f"P{k}", "label": "pos", "event_ids": ids})
    rows += [ob("n1", "ann", "good morning", 0, repository="acme/n"), ob("n2", "bob", "hello", 5, repository="acme/n")]
    labels.append({"id": "N1", "label": "human", "event_ids": ["n1", "n2"]})
    (tmp_path / "o.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "l.json").write_text(json.dumps({"clusters": labels}))
    report = evaluate_files(spark, str(tmp_path / "o.jsonl"), str(tmp_path / "l.json"))
    assert report["counts"] == {"observations": 8, "scenarios": 3, "positive_scenarios": 2, "control_scenarios": 1}
    for part in ("metrics", "oracle_cluster_metrics"):
        assert report[part]["recall"] == 1.0 and report[part]["false_positives"] == 0
    assert report["presence_likelihood_ratios"]["linked_coordination_exchange"] > 1
    (tmp_path / "l.json").write_text(json.dumps({"clusters": [labels[0], labels[0] | {"id": "X"}]}))
    with pytest.raises(ValueError, match="leakage"):
        evaluate_files(spark, str(tmp_path / "o.jsonl"), str(tmp_path / "l.json"))


def test_metadata_is_open(spark, observations, tmp_path):
    given = {"z": 1, "labels": ["a", "é"], "title": 'say "x"', "deep": {"b": None, "a": [1, 2.5, {"q": True}]}, "actor_type": "User", "sha": "ABC", "big": 123456789012345678901234567890}
    rows = observations([ob(1, "a", "t", metadata=given), ob(2, "a", "t"), ob(3, "a", "t", metadata={"commit_messages": "no list", "actor_type": 5})])
    got = {r["source_event_id"]: r for r in rows.collect()}
    assert json.loads(got["1"]["metadata_json"]) == given and list(json.loads(got["1"]["metadata_json"])) == sorted(given)
    assert got["1"]["actor_type"] == "User" and got["1"]["context_ids"] == ["abc"] and got["2"]["metadata_json"] == "{}"
    assert json.loads(got["3"]["metadata_json"]) == {"commit_messages": "no list", "actor_type": 5} and got["3"]["commit_messages"] == []
    write_parquet(rows, str(tmp_path / "out"))
    kept = duckdb.sql(f"SELECT metadata_json FROM '{tmp_path}/out/*.parquet' WHERE source_event_id = '1'").df()
    assert json.loads(kept["metadata_json"][0]) == given
    with pytest.raises(Exception, match="must be an object"):
        observations([ob(1, "a", "t", metadata=["x"])]).collect()
    path = tmp_path / "twice.jsonl"
    path.write_text(json.dumps(ob(1, "a", "t", metadata={"k": 1})).replace('{"k": 1}', '{"k": 1, "k": 2}') + "\n")
    assert json.loads(read_jsonl(spark, str(path)).first()["metadata_json"]) == {"k": 2}


def test_metadata_of_archives_and_campaigns(spark, tmp_path):
    from skein.plans.campaign import _as_found

    path = write_archive(tmp_path / "a.json.gz", [json.dumps(e) for e in EVENTS])
    rows, _ = archive.read_archive(spark, path, archive.Limits(sample_rate=0.0, max_text_chars=8), "2026-01-05-12")
    got = {r["source_event_id"]: json.loads(r["metadata_json"]) for r in rows.collect()}
    assert got["1"]["archive_hour"] == "2026-01-05-12" and got["1"]["candidate_retained"] and got["1"]["text_truncated"] and got["1"]["public"] and "payload_action" in got["1"]
    assert got["3"]["commit_messages"] == ["checkpoint one", "two"] and got["3"]["commit_count"] == len(EVENTS[2]["payload"]["commits"]) and "commit_count" not in got["1"]
    found = [json.loads(r["metadata_json"]) for r in _as_found(rows, "q", "gh", 1).collect()]
    assert all(m["origin_source"] == "gharchive" and m["campaign_query"] == "q" and m["archive_hour"] for m in found)


def test_archive_within_its_quotas_is_counted_as_it_is_read(spark, tmp_path, monkeypatch):
    import json

    from skein.sources import archive

    def not_called(*a):
        raise AssertionError("no kind is beyond its quota")

    monkeypatch.setattr(archive, "ordinals", not_called)
    rows = [{"id": str(i), "type": "PushEvent", "created_at": "2026-01-05T12:00:00Z", "payload": {"commits": [{"sha": "s", "message": "heartbeat" if i % 2 else "plain"}]}} for i in range(5)]
    (tmp_path / "full").write_text("".join(json.dumps(r) + "\n" for r in rows) + '\n{"type": "WatchEvent"}\n')
    got, counters = archive.read_archive(spark, str(tmp_path / "full"), archive.Limits(sample_rate=1.0))
    assert got.count() == 5 and {k: counters[k] for k in ("events_scanned", "relevant_events", "candidate_observations", "sampled_observations", "malformed_events")} == {"events_scanned": 6, "relevant_events": 5, "candidate_observations": 2, "sampled_observations": 3, "malformed_events": 0}
    (tmp_path / "none").write_text("")
    got, counters = archive.read_archive(spark, str(tmp_path / "none"))
    assert got.count() == 0 and not any(counters.values())
