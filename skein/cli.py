"""Commands over a store of observations: collect and analyse, watch, review, report. ``python -m skein COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import os
import smtplib
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import scoring, state
from skein.plans import campaign, reports
from skein.plans.analyze import Analysis, analyze, bundles, summary
from skein.plans.corpus import evaluate_files
from skein.scratch import written
from skein.sources import archive, feeds, fetch
from skein.sources.observations import RAW, canonical, read_jsonl, write_parquet
from skein.store import Store
from skein.streaming.watch import Monitor

VERSION = "1"
OWNERS = ["openai", "anthropics", "google-deepmind", "huggingface", "microsoft"]
SOURCES = ("github-thread", "github-code", "grep", "reddit")
#: A search service gives a thousand items at most; so many pages hold them.
SEARCHED = 1000

QUERY, LIMIT = ("--query", {"required": True}), ("--limit", {"type": int, "default": 100})
CALIBRATION = ("--calibration", {"help": "JSON profile of likelihood ratios"})
QUERIES = ("--queries", {"required": True, "help": "YAML file of query families"})
REPORT, PAGE = ("--report", {"default": "reports/findings.md"}), ("--html", {"default": "reports/site/index.html"})
LEDGER = [
    ("--ledger", {"default": "ledger/repos", "help": "a folder of files, or the address (scheme://...) of a table"}),
    ("--recheck-repository", {"action": "append", "default": []}),
    ("--recheck-stale", {"type": int, "metavar": "DAYS"}),
    ("--recheck-all", {"action": "store_true"}),
    ("--continuous-owner", {"action": "append", "default": list(OWNERS)}),
]


def threshold(value: float) -> tuple[str, dict]:
    return "--threshold", {"type": float, "default": value}


def searching(limit: int, threads: int, comments: int, least: float, minutes: int) -> list[tuple[str, dict]]:
    numbers = {"--limit": limit, "--threads": threads, "--comments": comments, "--window-minutes": minutes, "--concurrency": 2, "--retries": 2}
    return [QUERIES, ("--sources", {"default": "github-thread,github-code,grep"}), *[(k, {"type": int, "default": v}) for k, v in numbers.items()], threshold(least), CALIBRATION, *LEDGER]


#: Each command with its help and options.
COMMANDS: dict[str, tuple[str, list[tuple[str, dict]]]] = {
    "demo": ("analyse a small made-up exchange", []),
    "github-search": ("search issues and pull requests", [QUERY, LIMIT, threshold(0.60)]),
    "github-thread-search": ("search issues and pull requests and read their conversations", [QUERY, ("--threads", {"type": int, "default": 20}), ("--comments", {"type": int, "default": 100}), threshold(0.60)]),
    "github-code-search": ("search code; needs a token", [QUERY, LIMIT, threshold(0.60)]),
    "github-events": ("read the newest public events", [("--pages", {"type": int, "default": 1}), threshold(0.60)]),
    "grep-search": ("search code snippets", [QUERY, LIMIT, threshold(0.60)]),
    "gharchive-hour": (
        "read an hour of the archive of public events",
        [
            ("--hour", {"required": True, "help": "YYYY-MM-DDTHH or YYYY-MM-DD-HH"}),
            ("--limit", {"type": int, "help": "read so many lines at most"}),
            ("--sample-rate", {"type": float, "default": 0.05}),
            ("--event-types", {"default": ",".join(archive.EVENT_TYPES)}),
            ("--max-observations", {"type": int, "default": 10_000}),
            ("--max-download-mb", {"type": float, "default": 512.0}),
            ("--reprocess", {"action": "store_true"}),
            ("--repository", {"action": "append", "default": []}),
            ("--folder", {"default": "archive", "help": "where hours are kept; one that is there is not fetched"}),
            ("--parquet", {"help": "also write the observations there"}),
            threshold(0.60),
        ],
    ),
    "analyze-jsonl": ("analyse observations in JSON lines", [("path", {}), threshold(0.60), CALIBRATION]),
    "evaluate-corpus": ("hold the analysis against labelled scenarios", [("observations", {}), ("labels", {}), threshold(0.60)]),
    "export-reviewable": ("print reviewable bundles of the store", [("--limit", {"type": int, "default": 10_000}), threshold(0.60)]),
    "campaign": ("run many queries over many sources", [*searching(20, 5, 50, 0.60, 60), ("--top", {"type": int, "default": 20})]),
    "watch": (
        "run a campaign again and again until a reviewable finding",
        [*searching(20, 5, 50, 0.75, 1440), ("--interval", {"type": int, "default": 300}), ("--history-limit", {"type": int, "default": 20_000}), ("--query-batch-size", {"type": int, "default": 2}), ("--once", {"action": "store_true"})],
    ),
    "review-alert": ("close an alert", [("alert_id", {"type": int}), ("--status", {"required": True, "choices": ["reviewed", "false-positive", "escalated"]})]),
    "db-health": ("sizes, counts and times of the store", []),
    "notify-email": ("mail alerts that were not mailed yet", [("--db", {"help": "the store's folder"}), ("--recipient", {"required": True}), ("--test", {"action": "store_true"})]),
    "export-ledger": ("write the ledger of repositories from the store", [QUERIES, LEDGER[0], ("--limit", {"type": int, "default": 100_000}), threshold(0.75)]),
    "export-findings": ("write the reports", [REPORT, PAGE]),
    "rescore-findings": ("score stored findings again and write the reports", [threshold(0.75), REPORT, PAGE]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skein", description="Find public patterns of coordination between automated actors.")
    out.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    out.add_argument("--store", default=os.environ.get("SKEIN_STORE", "skein-store"), help="folder of the store")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (said, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=said, description=said)
        for option, how in options:
            sub.add_argument(option, **how)
    return out


def _told(value: dict) -> None:
    print(json.dumps(value, indent=2, default=str), flush=True)


def _calibration(args) -> scoring.CalibrationProfile | None:
    return scoring.CalibrationProfile.load(args.calibration) if args.calibration else None


def _analysed(spark: SparkSession, store: Store, observations: DataFrame, args, **more) -> None:
    """Keeps observations, analyses them, keeps the highest bundles and prints the summary."""
    observations = written(observations, "observations")
    if observations.isEmpty():
        return _told({"observations": 0, "clusters": 0, "reviewable_clusters": 0} | more)
    store.observations.put(observations.dropDuplicates(["event_key"]))
    a = analyze(observations, args.threshold, calibration=_calibration(args) if hasattr(args, "calibration") else None)
    campaign.keep(store, a, observations, 100)
    _told({"observations": observations.count()} | summary(a.scores, 20, a.clustered) | more)


DEMO = [
    ("hub", "post", "Delegate task_id=count-4410 to the worker. nonce=piece-51d0c7e2-part-0417", 0, None, ["piece-51d0c7e2-part-0417"]),
    ("hand", "reply", "ACK task_id=count-4410 nonce=piece-51d0c7e2-part-0417", 9, "1", ["piece-51d0c7e2-part-0417"]),
    ("hub", "reply", "heartbeat: worker alive, retry_count=1, checkpoint", 16, "2", []),
    ("hand", "reply", "Task completed task_id=count-4410; result: success", 24, "1", []),
]


def demo_observations(spark: SparkSession) -> DataFrame:
    start = datetime(2026, 1, 5, 12, tzinfo=UTC)
    rows = []
    for i, (actor, kind, text, after, reply, blocks) in enumerate(DEMO, 1):
        when = (start + timedelta(seconds=after)).isoformat()
        row = {"source": "demo", "source_event_id": str(i), "observed_at": when, "event_time": when, "actor": actor, "event_type": kind, "text": text, "repository": "demo/pair", "thread_id": "1", "reply_to": reply, "code_blocks": blocks}
        rows.append(row | {"provenance": {"url": f"https://example.invalid/{i}"}})
    return canonical(fetch.payloads(spark, rows, RAW).withColumn("ingest_ord", F.monotonically_increasing_id()))


def _exported(a: Analysis, observations: DataFrame) -> DataFrame:
    return bundles(a, observations).drop("fired", "label", "_g", "groups", "sel")


def _allowed(spark: SparkSession, args) -> Callable[[DataFrame], DataFrame]:
    """Repositories that the ledger does not cover."""

    def allowed(repositories: DataFrame) -> DataFrame:
        done = state.read_ledger(spark, args.ledger)
        if done is None:
            return repositories
        return state.allowed_repositories(repositories, done, recheck_all=args.recheck_all, recheck=args.recheck_repository, stale_days=args.recheck_stale, continuous_owners=args.continuous_owner)

    return allowed


def factories(spark: SparkSession, args, web: fetch.Web) -> dict[str, feeds.CollectorFactory]:
    allowed = _allowed(spark, args)

    known: dict[str, feeds.CollectorFactory] = {
        "github-thread": lambda q, page: fetch.Threads(web.get, q, args.threads, args.comments, page, allowed),
        "github-code": lambda q, page: fetch.Code(web.get, q, args.limit, page),
        "grep": lambda q, page: fetch.Snippets(web.get, q, args.limit, page),
        "reddit": lambda q, page: fetch.Forum(web.get, q, args.limit, args.comments),
    }
    chosen = [s.strip() for s in args.sources.split(",") if s.strip()]
    if unknown := sorted(set(chosen) - set(known)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return {s: known[s] for s in chosen}


def _options(args) -> campaign.Options:
    return campaign.Options(args.threshold, args.window_minutes, args.concurrency, args.retries, calibration=_calibration(args))


def _campaign(spark: SparkSession, store: Store, args, web: fetch.Web) -> int:
    done = campaign.run(spark, feeds.read_queries(args.queries), factories(spark, args, web), store, _options(args), _allowed(spark, args), args.ledger, VERSION)
    _told(done.summary(args.top))
    return 1 if done.errors and done.observations is None else 0


def watch_once(spark: SparkSession, store: Store, args, web: fetch.Web, on: dict[str, feeds.CollectorFactory] | None = None) -> dict:
    """One round: the next queries, what is new, and an alert if that raises a reviewable cluster of the newest history."""
    if waiting := store.control.pending():
        return {"state": "paused", "alert": waiting["id"]}
    queries = feeds.read_queries(args.queries)
    step = -(-args.limit // fetch.PAGE)
    options = _options(args)
    options.rotate = True
    options.page_limits = {"github-thread": max(1, SEARCHED // max(1, args.threads)), "github-code": max(1, SEARCHED // min(fetch.PAGE, max(1, args.limit))), "grep": 100}
    options.page_steps = {"github-code": max(1, step), "grep": max(1, -(-args.limit // fetch.SNIPPET_PAGE))}
    done = campaign.run(spark, store.control.take_batch(queries, args.query_batch_size), on or factories(spark, args, web), store, options, _allowed(spark, args), args.ledger, VERSION)
    told = {"errors": done.errors, "search_pages": done.pages}
    if done.observations is None:
        return {"state": "watching", "observations": 0} | told
    monitor = Monitor(store, args.threshold, args.window_minutes, args.history_limit, calibration=options.calibration)
    return monitor.judge(done.observations) | told


def _watch(spark: SparkSession, store: Store, args, web: fetch.Web) -> int:
    while True:
        result = watch_once(spark, store, args, web)
        _told(result)
        if args.once:
            return 2 if result["state"] == "paused" else 0
        time.sleep(max(1, args.interval))


def _archive_hour(spark: SparkSession, store: Store, args, web: fetch.Web) -> int:
    kinds = tuple(k.strip() for k in args.event_types.split(",") if k.strip())
    if not kinds:
        raise ValueError("no event types are given")
    hour, most = archive.hour_name(args.hour), int(args.max_download_mb * (1 << 20))
    if not store.control.begin("gharchive", hour, again=args.reprocess):
        _told({"state": "skipped", "reason": "partition_complete", "partition": hour, "stats": (store.control.partition("gharchive", hour) or {}).get("stats")})
        return 0
    counters: dict = {}
    try:
        limits = archive.Limits(args.sample_rate, args.max_observations, event_types=kinds, repositories=tuple(args.repository), max_lines=args.limit)
        path, counters = fetch.archive_file(hour, args.folder, web, most)
        fetch.whole_lines(path, limits.max_event_bytes)
        rows, read = archive.read_archive(spark, path, limits, hour)
        counters |= read
        rows = written(rows, "archive")
        if args.parquet:
            write_parquet(rows, args.parquet)
        _analysed(spark, store, rows, args, ingestion=counters)
    except Exception as e:
        store.control.finish("gharchive", hour, counters, f"{type(e).__name__}: {e}")
        raise
    store.control.finish("gharchive", hour, counters)
    return 0


def _rescore(spark: SparkSession, store: Store, args) -> int:
    told, alerts = [], {a["cluster_id"]: a for a in store.control.state["alerts"]}
    signals, facts = store.signals.rows(spark), store.facts.rows(spark)
    if alerts and signals is not None and facts is not None:
        own = spark.createDataFrame([(c,) for c in alerts], "cluster_id string")
        scores = scoring.score(signals.join(own, "cluster_id", "left_semi"), facts.join(own, "cluster_id", "left_semi"), args.threshold)
        for r in scores.select("cluster_id", "score", "confidence", "reasons").collect():
            alert = alerts[r["cluster_id"]]
            store.control.rescored(alert["id"], {"score": r["score"], "confidence": r["confidence"], "reasons": list(r["reasons"])})
            told.append({"id": alert["id"], "score": r["score"]})
    reports.write_reports(store.control.findings(), args.report, args.html)
    _told({"findings": sorted(told, key=lambda x: x["id"]), "report": args.report, "html": args.html})
    return 0


def mail(recipient: str, subject: str, body: str) -> None:
    """By the mail server that SKEIN_SMTP names (host or host:port), else by the one on this machine."""
    message = EmailMessage()
    message["To"], message["From"], message["Subject"] = recipient, os.environ.get("SKEIN_MAIL_FROM", recipient), subject
    message.set_content(body)
    host, _, port = os.environ.get("SKEIN_SMTP", "localhost").partition(":")
    with smtplib.SMTP(host, int(port or 25)) as server:
        server.send_message(message)


def notify(control: state.Control, recipient: str, test: bool = False, send: Callable[[str, str, str], None] = mail) -> int:
    """Mails pending alerts that were not mailed to this recipient; each counts as sent once its mail was taken."""
    if test:
        send(recipient, "Test", "Mail of alerts works.")
        return 1
    waiting = control.unsent("email", recipient)
    for alert in waiting:
        s = alert["summary"]
        lines = [f"Score {s.get('score')} ({s.get('confidence')})", *[f"- {reports.plain(x)}" for x in s.get("reasons", [])], *s.get("provenance", [])[: reports.MOST_LINKS], "", reports.CAUTION]
        send(recipient, f"Finding {alert['id']} waits for review", "\n".join(map(str, lines)))
        control.sent("email", recipient, alert["id"])
    return len(waiting)


def session() -> SparkSession:
    return SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, web: fetch.Web | None = None) -> int:
    args = parser().parse_args(argv)
    store, web = Store(getattr(args, "db", None) or args.store), web or fetch.Web.from_environment()
    if args.command == "review-alert":
        resolved = store.control.resolve(args.alert_id, args.status)
        _told({"alert_id": args.alert_id, "status": args.status, "resolved": resolved})
        return 0 if resolved else 1
    if args.command == "notify-email":
        _told({"sent": notify(store.control, args.recipient, args.test), "test": args.test})
        return 0
    if args.command == "export-findings":
        found = store.control.findings()
        reports.write_reports(found, args.report, args.html)
        _told({"report": args.report, "html": args.html, "findings": len(found)})
        return 0
    spark = spark or session()
    if args.command == "demo":
        observations = written(demo_observations(spark), "demo")
        for line in _exported(analyze(observations, 0.75), observations).toJSON().collect():
            print(line)
        return 0
    if args.command == "db-health":
        _told(store.health())
        return 0
    if args.command == "evaluate-corpus":
        _told(evaluate_files(spark, args.observations, args.labels, args.threshold))
        return 0
    if args.command == "gharchive-hour":
        return _archive_hour(spark, store, args, web)
    if args.command == "campaign":
        return _campaign(spark, store, args, web)
    if args.command == "watch":
        return _watch(spark, store, args, web)
    if args.command == "rescore-findings":
        return _rescore(spark, store, args)
    if args.command in ("export-reviewable", "export-ledger"):
        held = store.newest(spark, args.limit)
        a = None if held is None else analyze(held := written(held, "held"), args.threshold)
        if args.command == "export-ledger":
            n = state.write_ledger(state.ledger_rollup(a.clustered, held, a.scores), args.ledger, feeds.read_queries(args.queries), VERSION) if a else 0
            _told({"repositories": n, "ledger": args.ledger})
        elif a:
            for line in reports.public_bundles(_exported(Analysis(a.features, a.clustered, a.signals, a.scores.filter("reviewable")), held)).toJSON().toLocalIterator():
                print(line)
        return 0
    found = {
        "analyze-jsonl": lambda: read_jsonl(spark, args.path),
        "github-search": lambda: fetch.Issues(web.get, args.query, args.limit).collect(spark),
        "github-thread-search": lambda: fetch.Threads(web.get, args.query, args.threads, args.comments).collect(spark),
        "github-code-search": lambda: fetch.Code(web.get, args.query, args.limit).collect(spark),
        "github-events": lambda: fetch.Events(web.get, args.pages).collect(spark),
        "grep-search": lambda: fetch.Snippets(web.get, args.query, args.limit).collect(spark),
    }
    if args.command == "github-code-search" and not web.token:
        print("a code search needs GITHUB_TOKEN or GH_TOKEN", file=sys.stderr)
        return 2
    _analysed(spark, store, found[args.command](), args)
    return 0
