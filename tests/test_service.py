"""Searches, threads and the feed of public events, asked by executors from a server of fixed pages."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from skein.sources import fetch, service


class Fixture:
    """A service whose answers are given: path and page to items. Remembers what was asked."""

    def __init__(self):
        self.answers, self.asked = {}, []
        fixture = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urllib.parse.urlparse(self.path)
                params = dict(urllib.parse.parse_qsl(url.query))
                fixture.asked.append((url.path, params))
                body = fixture.answers.get(url.path)
                self.send_response(200 if body else 404)
                self.end_headers()
                if body:
                    self.wfile.write(json.dumps(body(params)).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.web = fetch.Web(address=f"http://127.0.0.1:{self.server.server_port}")


@pytest.fixture
def fixture():
    made = Fixture()
    yield made
    made.server.shutdown()


def paged(items):
    return lambda p: items[(int(p["page"]) - 1) * int(p["per_page"]) : int(p["page"]) * int(p["per_page"])]


def event_rows(spark):
    return [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(450).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).collect()]


def issue(r):
    name = f"Org{r['user_id'] % 3}/w"
    return {"id": r["event_id"], "number": r["event_id"] % 50, "title": f"t{r['event_id']}", "body": "x", "created_at": r["at"], "repository_url": f"https://api.github.com/repos/{name}", "html_url": "https://h/1", "user": {"login": "a", "type": "User"}}


def search(items):
    """Like the service, which heeds ``repo:`` in a query whatever the case."""

    def answer(p):
        words = p["q"].lower().split()
        wanted, refused = ({w.split(":")[1] for w in words if w.startswith(mark)} for mark in ("repo:", "-repo:"))
        own = [x for x in items if (not wanted or x["repository_url"].split("/repos/")[1].lower() in wanted) and x["repository_url"].split("/repos/")[1].lower() not in refused]
        return {"items": paged(own)(p)}

    return answer


def test_pages_read_back_equal_and_are_partitions(spark, fixture):
    items = [issue(r) for r in event_rows(spark)]
    fixture.answers["/search/issues"] = search(items)
    rows = service.search(spark, fixture.web, "issues", "delegate", pages=6)
    assert rows.rdd.getNumPartitions() == 6
    got = rows.orderBy("page", "place").collect()
    assert [json.loads(r["raw"]) for r in got] == items and {r["repository"] for r in got} == {"Org0/w", "Org1/w", "Org2/w"}
    source = fetch.Issues(fixture.web.get, "delegate", 120)
    assert source.collect(spark).count() == 120 and not source.exhausted
    source = fetch.Issues(fixture.web.get, "delegate", 1000)
    assert {r["source_event_id"] for r in source.collect(spark).select("source_event_id").collect()} == {f"issue:{x['id']}" for x in items} and source.exhausted


def test_filters_narrow_the_question(spark, fixture):
    items = [issue(r) for r in event_rows(spark)]
    fixture.answers["/search/issues"] = search(items)
    rows = service.search(spark, fixture.web, "issues", "delegate", pages=6)
    assert rows.filter("repository = 'Org1/w'").count() == sum("Org1" in x["repository_url"] for x in items)
    assert {p["q"] for _, p in fixture.asked} == {"delegate repo:Org1/w"}
    fixture.asked.clear()
    assert rows.filter("NOT repository IN ('Org1/w', 'Org2/w')").count() == sum("Org0" in x["repository_url"] for x in items)
    assert {p["q"] for _, p in fixture.asked} == {"delegate -repo:Org1/w -repo:Org2/w"}
    assert rows.filter("repository = 'org1/W'").count() == 0  # asked for, but Spark compares the case


def test_threads_of_refused_repositories_are_never_asked_for(spark, fixture):
    items = [issue(r) | ({"pull_request": {"url": "u"}} if r["event_id"] % 2 else {}) for r in event_rows(spark)[:30]]
    fixture.answers["/search/issues"] = search(items)
    said = lambda n: {"id": n, "body": f"said {n}", "created_at": "2026-01-05T12:00:00Z", "html_url": "https://h/c", "user": {"login": "b", "type": "User"}}
    for x in items:
        for kind in ("issues", "pulls"):
            fixture.answers[f"/repos/{x['repository_url'].split('/repos/')[1]}/{kind}/{x['number']}/comments"] = paged([said(1000 * x["number"] + k) for k in range(3)])
    allowed = lambda repositories: repositories.filter("repository <> 'Org0/w'")
    got = fetch.Threads(fixture.web.get, "q", threads=30, comments=2, allowed=allowed).collect(spark)
    roots = [x for x in items if "Org0" not in x["repository_url"]]
    pulls = [x for x in roots if "pull_request" in x]
    assert {r["repository"] for r in got.select("repository").collect()} == {"Org1/w", "Org2/w"}
    assert got.groupBy("event_type").count().collect() and got.count() == len(roots) + 2 * len(roots) + 2 * len(pulls)
    assert not [path for path, _ in fixture.asked if path.startswith("/repos/Org0")]
    assert not [path for path, _ in fixture.asked if "/pulls/" in path and not any(f"/{x['number']}/" in path for x in pulls)]


def test_snippets_and_events_by_pages(spark, fixture):
    fixture.answers["/api/search"] = lambda p: {"hits": {"hits": [{"repo": {"raw": "Acme/W"}, "path": {"raw": f"a{p['page']}.py"}, "content": {"snippet": "<b>x</b>"}}] * 10 if int(p["page"]) < 3 else []}}
    source = fetch.Snippets(fixture.web.get, "q", 25)
    assert source.collect(spark).count() == 20 and source.exhausted
    events = [{"id": str(i), "type": "IssuesEvent", "created_at": "2026-01-05T12:00:00Z", "actor": {"login": "a"}, "repo": {"name": "acme/w"}, "payload": {"issue": {"id": i, "number": i, "title": "t", "body": "", "html_url": ""}}} for i in range(150)]
    fixture.answers["/events"] = paged(events)
    assert fetch.Events(fixture.web.get, pages=2).collect(spark).count() == 150


def test_the_feed_resumes_without_repeats_or_losses(spark, fixture, tmp_path):
    feed = [{"id": str(r["event_id"] + 1), "type": "WatchEvent", "repo": {"name": f"org{r['user_id'] % 3}/w"}} for r in event_rows(spark)]
    shown = {"n": 120}
    fixture.answers["/events"] = lambda p: paged(feed[: shown["n"]][::-1][:300])(p)  # newest first, and no more than 300

    def run(**options):
        stream = service.event_stream(spark, fixture.web, size=50, **options)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def ids():
        return sorted(int(json.loads(r["raw"])["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for n in (120, 121, 400):
        shown["n"] = n
        run()
        assert ids() == sorted(int(x["id"]) for x in feed[:n])
    run()
    assert ids() == sorted(int(x["id"]) for x in feed[:400])
    # A batch that was planned before a crash is the same when it is read again, though the feed has moved on.
    reader, wanted = service.EventFeedReader(service._options(fixture.web)), service.EventRange(int(feed[99]["id"]), int(feed[149]["id"]))
    shown["n"] = 150
    first = [r[3] for r in reader.read(wanted)]
    shown["n"] = 380
    assert [r[3] for r in reader.read(wanted)] == first and len(first) == 50
    shown["n"] = 450
    with pytest.raises(RuntimeError, match="no longer holds"):
        list(reader.read(wanted))
