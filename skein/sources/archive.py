"""Hourly archives of public events: gzip JSON lines, filtered on their raw text before anything is decoded.

Type, repository, vocabulary and sample are decided on the line itself, so that most lines are never parsed; what is left
is normalised to observations and held to the quotas of the hour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.selection import ordinals
from skein.scratch import written
from skein.sources.observations import canonical

# Event types by default, and limits of one event.
EVENT_TYPES = ["IssuesEvent", "IssueCommentEvent", "PullRequestEvent", "PushEvent", "CreateEvent"]
MAX_CODE_BLOCKS, MAX_CODE_CHARS, MAX_URLS, MAX_URL_CHARS, MAX_MESSAGE_CHARS = 4, 4096, 20, 2048, 500
TYPE_ON_LINE = r'"type"\s*:\s*"([A-Za-z]+Event)"'
ID_ON_LINE = r'"id"\s*:\s*"([^"]+)"'
REPOSITORY_ON_LINE = r'"repo"\s*:\s*\{[^{}]*"name"\s*:\s*"([^"]+)"'
_ISSUE = "struct<id:long,number:long,title:string,body:string,html_url:string>"
EVENT = (
    "id string, type string, created_at string, public boolean, actor struct<login:string,type:string>, repo struct<name:string>, "
    f"payload struct<action:string,issue:{_ISSUE},comment:struct<id:long,body:string,html_url:string>,pull_request:{_ISSUE},"
    "commits:array<struct<sha:string,message:string,url:string,author:struct<email:string>>>,ref_type:string,ref:string,description:string>"
)


@dataclass(frozen=True)
class Limits:
    sample_rate: float = 0.05
    max_observations: int = 10_000
    max_event_bytes: int = 2 << 20
    max_text_chars: int = 20_000
    event_types: tuple[str, ...] = tuple(EVENT_TYPES)
    repositories: tuple[str, ...] = ()
    #: Read so many lines at most (all if None).
    max_lines: int | None = None

    @property
    def background(self) -> int:
        return self.max_observations // 5

    @property
    def candidates(self) -> int:
        return self.max_observations - self.background


def hour_name(hour: str) -> str:
    """``YYYY-MM-DDTHH`` or ``YYYY-MM-DD-HH``, with or without Z, as the archive names it (the hour unpadded)."""
    import re

    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[T-](\d{1,2})Z?", hour.strip())
    if not m or int(m[2]) > 23:
        raise ValueError(f"not an hour: {hour}")
    return f"{m[1]}-{int(m[2])}"


def prefilter(lines: DataFrame, limits: Limits) -> DataFrame:
    """Lines (value, line_no) that may matter, with ``raw_candidate`` and ``sampled``."""
    value = F.col("value")
    kind = F.regexp_extract(value, TYPE_ON_LINE, 1)
    out = lines.filter((F.octet_length("value") <= limits.max_event_bytes) & (F.length("value") > 0)).filter(kind.isin(list(limits.event_types)) | (kind == ""))
    if limits.repositories:
        out = out.filter(F.lower(F.regexp_extract(value, REPOSITORY_ON_LINE, 1)).isin([r.lower() for r in limits.repositories]))
    out = out.withColumns({"raw_candidate": value.rlike(X.CANDIDATE), "sampled": X.hash_sample(F.regexp_extract(value, ID_ON_LINE, 1), limits.sample_rate)})
    return out.filter("raw_candidate OR sampled")


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def normalise(events: DataFrame, retrieval_method: str) -> DataFrame:
    """Raw observations of decoded events (column ``e``); other types are dropped."""
    p, kind = "e.payload", F.col("e.type")
    col = lambda name: F.col(f"{p}.{name}")
    commits = F.coalesce(col("commits"), F.array().cast("array<struct<sha:string,message:string,url:string,author:struct<email:string>>>"))
    said = F.filter(commits, lambda c: F.coalesce(c["message"], F.lit("")) != "")
    is_ = lambda name: kind == name
    text = (
        F.when(is_("IssuesEvent"), _joined(col("issue.title"), col("issue.body")))
        .when(is_("IssueCommentEvent"), F.coalesce(col("comment.body"), F.lit("")))
        .when(is_("PullRequestEvent"), _joined(col("pull_request.title"), col("pull_request.body")))
        .when(is_("PushEvent"), F.array_join(F.transform(said, lambda c: c["message"]), "\n"))
        .otherwise(_joined(col("ref_type"), col("ref"), col("description")))
    )
    text = F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))
    thread = F.when(is_("IssuesEvent") | is_("IssueCommentEvent"), col("issue.number")).when(is_("PullRequestEvent"), col("pull_request.number")).cast("string")
    first_commit = F.get(F.filter(F.transform(commits, lambda c: c["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), 0)
    own = (
        F.when(is_("IssuesEvent"), col("issue.html_url"))
        .when(is_("IssueCommentEvent"), F.coalesce(F.nullif(col("comment.html_url"), F.lit("")), col("issue.html_url")))
        .when(is_("PullRequestEvent"), col("pull_request.html_url"))
        .when(is_("PushEvent"), first_commit)
    )
    home = F.when(F.coalesce(F.col("e.repo.name"), F.lit("")) != "", F.concat(F.lit("https://github.com/"), F.col("e.repo.name"))).otherwise(F.lit("https://github.com"))
    emails = F.filter(F.transform(commits, lambda c: F.coalesce(c["author"]["email"], F.lit(""))), lambda m: m.contains("@"))
    push = is_("PushEvent")
    meta = F.struct(
        *[F.lit(None).cast("string").alias(k) for k in ("origin_source", "campaign_source")],
        F.col("e.actor.type").alias("actor_type"),
        *[F.lit(None).cast("string").alias(k) for k in ("github_app_slug", "sha", "commit_sha", "head_sha", "event_id", "node_id", "check_run_id", "workflow_run_id", "installation_id")],
        F.when(push, F.transform(said, lambda c: F.substring(c["message"], 1, MAX_MESSAGE_CHARS))).alias("commit_messages"),
        F.when(push, F.array_sort(F.array_distinct(F.transform(emails, lambda m: F.lower(F.substring_index(m, "@", -1)))))).alias("author_email_domains"),
    )
    said_of = {"public": F.coalesce("e.public", F.lit(True)), "payload_action": col("action"), "actor_type": F.col("e.actor.type")}
    about = {"conversation_root": F.when(is_("IssueCommentEvent"), F.concat(F.lit("issue:"), F.coalesce(col("issue.id").cast("string"), F.lit("None"))))}
    about |= {"commit_count": F.when(push, F.size(commits)), "commit_shas": F.when(push, F.filter(F.transform(commits, lambda c: c["sha"]), lambda x: F.coalesce(x, F.lit("")) != ""))}
    # Of a push or a comment only: absent elsewhere, where the others may be null.
    own_keys = F.to_json(F.struct(*[c.alias(k) for k, c in about.items()], meta["commit_messages"].alias("commit_messages"), meta["author_email_domains"].alias("author_email_domains")))
    always = F.to_json(F.struct(*[c.alias(k) for k, c in said_of.items()]), {"ignoreNullFields": "false"})
    whole = F.when(own_keys == "{}", always).otherwise(F.concat(F.substring(always, F.lit(1), F.length(always) - 1), F.lit(","), F.substring(own_keys, 2, 1 << 30)))
    nothing = F.lit(None).cast("string")
    out = events.filter(kind.isin(EVENT_TYPES)).withColumn("text", text)
    return out.select(
        *[c for c in events.columns if c != "e"],
        F.lit("github-events").alias("source"),
        F.col("e.id").alias("source_event_id"),
        nothing.alias("event_key"),
        F.current_timestamp().alias("observed_at"),
        F.coalesce(F.to_timestamp("e.created_at"), F.current_timestamp()).alias("event_time"),
        F.coalesce(F.col("e.actor.login"), F.lit("unknown")).alias("actor"),
        *[nothing.alias(k) for k in ("platform", "actor_key")],
        kind.alias("event_type"),
        "text",
        F.col("e.repo.name").alias("repository"),
        nothing.alias("resource_key"),
        thread.alias("thread_id"),
        *[nothing.alias(k) for k in ("conversation_key", "reply_to", "parent_key")],
        X.extract_urls(F.col("text")).alias("artifact_urls"),
        X.extract_code_blocks(F.col("text")).alias("code_blocks"),
        F.sha2(F.coalesce("text", kind), 256).alias("content_sha256"),
        meta.alias("metadata"),
        F.struct(F.coalesce(F.nullif(own, F.lit("")), home).alias("url"), F.lit(retrieval_method).alias("retrieval_method"), F.current_timestamp().alias("retrieved_at")).alias("provenance"),
        whole.alias("metadata_text"),
    )


def within_quotas(observations: DataFrame, limits: Limits, counts: dict[bool, int] | None = None) -> DataFrame:
    """``retained``: whether a row is among the first of its kind, in line order, up to the quota.

    Rows beyond a quota are marked, not lost, so that they can be counted. A quota's last line is found by counting digits
    of line numbers, so that no task holds, sorts or allocates as many rows as the quota says. ``counts`` of the kinds' rows,
    if known, save looking for the last line of a kind within its quota.
    """
    quotas = {True: limits.candidates, False: limits.background}
    cut = [(c, q - 1) for c, q in quotas.items() if q > 0 and (counts is None or counts[c] > q)]
    wanted = observations.sparkSession.createDataFrame(cut, "candidate boolean, k long")
    last = {r["candidate"]: r["line_no"] for r in ordinals(observations, ["candidate"], "line_no", wanted).collect()} if cut else {}
    # A kind with fewer rows than its quota has no last line and keeps all.
    within = {c: F.lit(False) if q <= 0 else F.col("line_no") <= last[c] if c in last else F.lit(True) for c, q in quotas.items()}
    return observations.withColumn("retained", F.when(F.col("candidate"), within[True]).otherwise(within[False]))


def truncated(observations: DataFrame, limits: Limits) -> DataFrame:
    cut = lambda c, n, size: F.transform(F.slice(c, 1, n), lambda x: F.substring(x, 1, size))
    return observations.withColumns(
        {
            "text_truncated": F.coalesce(F.length("text") > limits.max_text_chars, F.lit(False)),
            "text": F.substring("text", 1, limits.max_text_chars),
            "code_blocks": cut("code_blocks", MAX_CODE_BLOCKS, MAX_CODE_CHARS),
            "artifact_urls": cut("artifact_urls", MAX_URLS, MAX_URL_CHARS),
        }
    )


def read_archive(spark: SparkSession, path: str, limits: Limits = Limits(), hour: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Observations of an archive hour and its counters. A gzip stream that ends early is an error. ``hour`` is noted in
    the metadata, beside what of a row was found and cut."""
    lines = spark.read.text(path)
    if limits.max_lines is not None:
        lines = lines.filter(F.length("value") > 0).limit(limits.max_lines)
    lines = lines.withColumn("line_no", F.monotonically_increasing_id())
    lines = lines.filter(F.length("value") > 0)
    size = F.octet_length("value") <= limits.max_event_bytes
    named = F.regexp_extract("value", TYPE_ON_LINE, 1)
    typed = size & (named.isin(list(limits.event_types)) | (named == ""))
    listed = F.lower(F.regexp_extract("value", REPOSITORY_ON_LINE, 1)).isin([r.lower() for r in limits.repositories]) if limits.repositories else F.lit(True)
    # Counters are taken as the lines pass, which are read and decoded once.
    scan, bad, kept = Observation(), Observation(), Observation()
    lines = lines.observe(scan, F.count_if(size).alias("events_scanned"), F.count_if(typed & listed).alias("relevant_events"), F.count_if(typed & ~listed).alias("repository_filtered_events"), F.count_if(~size).alias("oversize"))
    # The lines that may matter are at rest before they are decoded.
    chosen = written(prefilter(lines, limits), "lines")
    decoded = chosen.withColumn("e", F.from_json("value", EVENT, {"mode": "PERMISSIVE"})).drop("value")
    decoded = decoded.observe(bad, F.count_if(F.col("e").isNull() | (F.col("e.id").isNull() & F.col("e.type").isNull())).alias("undecoded"))
    rows = normalise(decoded.filter(F.col("e.type").isin(list(limits.event_types))), "gharchive-hourly")
    rows = rows.withColumn("candidate", X.has(F.col("text"), X.CANDIDATE))
    rows = rows.observe(kept, F.count_if("candidate").alias("candidate_events"), F.count_if(~F.col("candidate") & F.col("sampled")).alias("sampled_events"))
    rows = written(rows.filter("candidate OR sampled"), "events")
    counters = {k: v for part in (scan, bad, kept) for k, v in part.get.items()}
    quotas = {"candidate": limits.candidates, "sampled": limits.background}
    # Line numbers are distinct, so that a quota is met exactly.
    counters |= {f"{kind}_observations": min(counters[f"{kind}_events"], max(0, quota)) for kind, quota in quotas.items()}
    rows = within_quotas(rows, limits, {True: counters["candidate_events"], False: counters["sampled_events"]})
    counters["malformed_events"] = counters.pop("oversize") + counters.pop("undecoded")
    counters["dropped_candidate_events"] = counters["candidate_events"] - counters["candidate_observations"]
    counters["dropped_sampled_events"] = counters["sampled_events"] - counters["sampled_observations"]
    counters["observations"] = counters["candidate_observations"] + counters["sampled_observations"]
    noted = F.struct(F.lit(hour).alias("archive_hour"), F.col("candidate").alias("candidate_retained"), F.when(F.col("text_truncated"), F.lit(True)).alias("text_truncated"))
    rows = truncated(rows.filter("retained"), limits)
    rows = rows.withColumn("metadata_text", F.concat(F.substring(F.col("metadata_text"), F.lit(1), F.length("metadata_text") - 1), F.lit(","), F.substring(F.to_json(noted), 2, 1 << 30)))
    rows = rows.withColumns({"source": F.lit("gharchive"), "event_key": F.concat(F.lit("github:event:gharchive:"), "source_event_id"), "ingest_ord": F.col("line_no")})
    return canonical(rows), counters
