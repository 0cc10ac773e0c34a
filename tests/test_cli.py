"""Commands over a store, with the network replaced by given payloads; campaigns, cursors, reports."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.plans import campaign, reports
from skein.sources import fetch
from skein.sources.observations import RAW, canonical
from skein.store import Store
from tests.conftest import observation as ob
from tests.test_analyze import exchange
from tests.test_sources import EVENTS


class Payloads(fetch.Web):
    """Answers by the end of the address; an address that is not given is refused."""

    def __init__(self, answers, **more):
        super().__init__(**more)
        self.answers, self.asked = answers, []

    def get(self, url, params):
        self.asked.append((url, params))
        for end, answer in self.answers.items():
            if url.endswith(end):
                return answer(params) if callable(answer) else answer
        raise fetch.Refused(404)


def run(spark, capsys, *argv, web=None):
    code = cli.main(list(argv), spark, web or Payloads({}))
    return code, capsys.readouterr().out


ISSUE = {"id": 1, "number": 5, "title": "A plan", "body": "Please run the build. task_id=alpha-7781", "created_at": "2026-01-05T12:00:00Z", "updated_at": "2026-01-05T13:00:00Z", "repository_url": "https://api.github.com/repos/acme/widgets", "html_url": "https://github.com/acme/widgets/issues/5", "user": {"login": "ann", "type": "User"}}


def test_analysis_of_a_file_keeps_and_exports_bundles(spark, tmp_path, capsys):
    path, store = tmp_path / "x.jsonl", str(tmp_path / "store")
    rows = exchange(ack={"reply_to": "1"}, done={"reply_to": "2"})
    rows[2]["text"] += " token=ghp_abcdefghijklmnopqrstuvwxyz0123456789"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    code, out = run(spark, capsys, "--store", store, "analyze-jsonl", str(path), "--threshold", "0.75")
    told = json.loads(out)
    assert code == 0 and told["observations"] == 3 and told["reviewable_clusters"] == 1 and told["confidence"]["high"] == 1
    code, out = run(spark, capsys, "--store", store, "export-reviewable", "--threshold", "0.75")
    (bundle,) = [json.loads(line) for line in out.splitlines()]
    assert [o["actor"] for o in bundle["observations"]] == ["alice-agent", "bob-agent", "bob-agent"] and "ghp_" not in out
    health = json.loads(run(spark, capsys, "--store", store, "db-health")[1])
    assert health["counts"]["observations"] == 3 and health["counts"]["bundles"] == 1 and health["bytes_on_disk"] > 0 and not health["pending_alert"]


def test_the_demo_finds_its_exchange(spark, tmp_path, capsys):
    code, out = run(spark, capsys, "--store", str(tmp_path), "demo")
    assert code == 0 and any(json.loads(line)["reviewable"] for line in out.splitlines())


def test_an_archive_hour_runs_once(spark, tmp_path, capsys):
    folder, store = tmp_path / "hours", str(tmp_path / "store")
    folder.mkdir()
    (folder / "2026-01-05-12.json.gz").write_bytes(gzip.compress("".join(json.dumps(e) + "\n" for e in EVENTS).encode()))
    call = ["--store", store, "gharchive-hour", "--hour", "2026-01-05T12", "--folder", str(folder), "--sample-rate", "0"]
    told = json.loads(run(spark, capsys, *call)[1])
    assert told["observations"] == 5 and told["ingestion"]["events_scanned"] == 7 and told["ingestion"]["compressed_bytes"] > 0
    assert json.loads(run(spark, capsys, *call)[1])["state"] == "skipped"
    with pytest.raises(RuntimeError, match="limit"):
        run(spark, capsys, *call, "--reprocess", "--max-download-mb", "0.00001")
    assert Store(store).control.partition("gharchive", "2026-01-05-12")["status"] == "failed"


def test_archives_stop_at_their_bounds(tmp_path):
    import io

    out = io.BytesIO()
    assert fetch.copied(io.BytesIO(b"abc"), out, 3) == 3 and out.getvalue() == b"abc"
    with pytest.raises(RuntimeError, match="limit"):
        fetch.copied(io.BytesIO(b"abcd"), io.BytesIO(), 3)
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(b"x" * 50 + b"\n" + b"y\n"))
    fetch.whole_lines(str(path), 10)
    path.write_bytes(gzip.compress(b"y\n" + b"x" * 50))
    with pytest.raises(RuntimeError, match="within a line"):
        fetch.whole_lines(str(path), 10)
    path.write_bytes(gzip.compress(b"y\n" * 900)[:-6])
    with pytest.raises(RuntimeError, match="checksum"):
        fetch.whole_lines(str(path), 10)


def test_searches_become_observations(spark):
    web = Payloads({"/search/issues": lambda p: {"items": [ISSUE] if p["page"] == 1 else []}, "/search/code": {"items": [{"sha": "s", "path": "a.py", "html_url": "https://x", "repository": {"full_name": "acme/widgets", "owner": {"login": "acme"}}}]}})
    source = fetch.Issues(web.get, "delegate", 5)
    row = source.collect(spark).first()
    assert source.exhausted and row["source_event_id"] == "issue:1" and row["thread_id"] == "5" and row["event_type"] == "issue" and row["repository"] == "acme/widgets"
    source = fetch.Code(web.get, "delegate", 1)
    row = source.collect(spark).first()
    assert not source.exhausted and row["text"] == "acme/widgets:a.py" and row["actor"] == "acme" and row["event_type"] == "code_search_hit"


def test_forum_reads_the_last_days_only(spark):
    from datetime import UTC, datetime

    now = datetime(2026, 1, 20, tzinfo=UTC)
    post = lambda i, at: {"id": i, "subreddit": "t", "author": "a", "created_utc": at, "title": "heartbeat", "selftext": "x"}
    fresh, stale = now.timestamp() - 86400, now.timestamp() - 15 * 86400
    web = Payloads({"/posts/search": {"data": [post("new", fresh), post("old", stale)]}, "/comments/search": lambda p: {"data": [{"id": "c" + p["link_id"], "subreddit": "t", "author": "b", "created_utc": fresh, "body": "yes", "link_id": "t3_" + p["link_id"], "parent_id": "t3_" + p["link_id"]}]}})
    got = fetch.Forum(web.get, "heartbeat", places=("t",), now=now).collect(spark)
    assert {r["source_event_id"] for r in got.collect()} == {"new", "cnew"}


def test_a_campaign_keeps_what_is_new_and_moves_on(spark, tmp_path):
    store, waits = Store(str(tmp_path / "store")), []

    class Given:
        exhausted = False

        def __init__(self, page):
            self.page = page

        def collect(self, spark):
            rows = [ob(self.page, "ann", "heartbeat", 0), ob(9, "bob", "the same in both", 5)]
            return canonical(fetch.payloads(spark, rows, RAW).withColumn("ingest_ord", F.monotonically_increasing_id()))

    tried = []

    class Busy:
        def collect(self, spark):
            tried.append(1)
            raise fetch.Refused(429, 7)

    factories = {"one": lambda q, page: Given(page), "two": lambda q, page: Given(page), "busy": lambda q, page: Busy()}
    options = campaign.Options(rotate=True, page_limits={"one": 3, "two": 3, "busy": 3}, retries=1, concurrency=1, sleep=waits.append)
    first = campaign.run(spark, ["q"], factories, store, options)
    assert first.observations.count() == 2 and len(tried) == 2 and waits[0] == 7
    assert [e["source"] for e in first.errors] == ["busy"] and "429" in first.errors[0]["error"]
    assert [store.control.page(s, "q") for s in ("one", "two", "busy")] == [2, 2, 1]
    assert store.observations.rows(spark).count() == 2 and store.bundles.rows(spark).count() >= 1
    second = campaign.run(spark, ["q"], factories, store, options)
    assert second.observations.count() == 1 and {p["source"]: p["page"] for p in second.pages} == {"one": 2, "two": 2, "busy": 1}


FINDING = {
    "id": 3, "status": "pending", "created_at": "2026-01-05T12:00:00+00:00",
    "summary": {"cluster_id": "c|`x`", "score": 0.87, "confidence": "high", "actors": ["<script>alert(1)</script>", "a`b"], "reasons": ["semantic=0.94", "[x](http://evil)"], "provenance": ["https://example.org/a", "javascript:alert(1)"]},
    "classification": {"classification": "benign", "summary": "token=ghp_abcdefghijklmnopqrstuvwxyz0123456789 <b>"}, "reviewer": "r", "model": None, "classification_created_at": None,
}


def test_reports_escape_and_redact(tmp_path):
    html, text = reports.page([FINDING]), reports.markdown([FINDING])
    assert "<script>" not in html and "&lt;script&gt;" in html and 'href="javascript' not in html and 'href="https://example.org/a"' in html
    assert "ghp_" not in html + text and "[REDACTED]" in html
    assert "\\[x\\]" in text and "``a`b``" in text and "<javascript" not in text
    reports.write_reports([FINDING], str(tmp_path / "r" / "f.md"), str(tmp_path / "r" / "i.html"))
    assert (tmp_path / "r" / "f.md").read_text().startswith("# Findings") and (tmp_path / "r" / "i.html").read_text().startswith("<!doctype html>")
    assert "No findings yet" in reports.page([])


def test_alerts_are_mailed_once_and_closed(spark, tmp_path, capsys):
    store, sent = Store(str(tmp_path)), []
    store.control.raise_alert("f", "c1", {"score": 0.9, "confidence": "high", "reasons": ["semantic=0.94"]})
    assert cli.notify(store.control, "A@b.c", send=lambda *m: sent.append(m)) == 1 == len(sent) and "semantic=0.94" in sent[0][2]
    assert cli.notify(store.control, "a@b.c", send=lambda *m: sent.append(m)) == 0
    assert run(spark, capsys, "--store", str(tmp_path), "review-alert", "1", "--status", "false-positive")[0] == 0
    assert run(spark, capsys, "--store", str(tmp_path), "review-alert", "1", "--status", "reviewed")[0] == 1
    code, out = run(spark, capsys, "--store", str(tmp_path), "export-findings", "--report", str(tmp_path / "f.md"), "--html", str(tmp_path / "f.html"))
    assert code == 0 and json.loads(out)["findings"] == 1 and "false-positive" in (tmp_path / "f.md").read_text()


def test_every_command_has_help(capsys):
    for name in cli.COMMANDS:
        with pytest.raises(SystemExit):
            cli.parser().parse_args([name, "--help"])
    assert len(cli.COMMANDS) >= 18
    capsys.readouterr()
