"""Readers, sinks and rules over notes made from events: code, quotes, negation, envelopes, secrets, feeds, ledger policy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import detection
from skein.catalog.synthetic import clustered, observations, table, with_obs
from skein.functions import text as X
from skein.operators import detectors, scoring, state
from skein.scratch import shared_path
from skein.sources import archive, feeds
from skein.sources.observations import read_jsonl, write_parquet

#: What an event's number makes of it, in one SQL text that both engines run.
_NOTES = """
SELECT event_id AS id, CASE event_id % 8
    WHEN 0 THEN 'intro' || chr(10) || '```py' || chr(10) || 'x = ' || event_id || chr(10) || '```' || chr(10) || 'outro'
    WHEN 1 THEN '> ACK quoted ' || event_id || chr(10) || 'own words ' || event_id
    WHEN 2 THEN '<details>hidden ' || event_id || '</details>shown ' || event_id
    WHEN 3 THEN 'We do not delegate this to ' || event_id
    WHEN 4 THEN 'We never rest. Please run it: ' || event_id
    WHEN 5 THEN 'no ```x``` worries, task is complete ' || event_id
    WHEN 6 THEN chr(123) || '"task_id": "job-' || event_id || '", "status": "ok"' || chr(125)
    ELSE 'token: password=hunter' || event_id || ' and sk-abcdefghijklmnopqrstuv' || event_id || ' and ghp_abcdefghijklmnopqrst' || event_id
  END AS text FROM events
"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NOTES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("id", F.explode(X.extract_code_blocks(F.col("text"))).alias("block"))


def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("id", X.clean_text(F.col("text")).alias("cleaned"))


def unnegated_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = X.speech_acts(X.clean_text(F.col("text")))
    return _notes(spark, sf_dir).select("id", F.array_join(acts, ",").alias("acts")).filter("acts <> ''")


def protocol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("id", F.array_join(X.protocol_hits(F.col("text")), ",").alias("classes")).filter("classes <> ''")


def redacted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("id", X.redact(F.col("text")).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as JSON lines, with metadata that nothing here knows, and read back."""
    e = table(spark, sf_dir, "events").join(_notes(spark, sf_dir).withColumnRenamed("id", "event_id"), "event_id")
    number, when = F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    row = F.struct(
        F.lit("jsonl").alias("source"), number.alias("source_event_id"), when.alias("observed_at"), when.alias("event_time"), F.concat(F.lit("User"), "user_id").alias("actor"), "event_type", "text",
        F.concat(F.lit("Acme/W"), F.col("user_id") % 7).alias("repository"), (F.col("user_id") % 9).cast("string").alias("thread_id"), F.when(F.col("event_id") % 4 == 1, (F.col("event_id") - 1).cast("string")).alias("reply_to"),
        F.struct(F.concat(F.lit("ABC"), number).alias("sha"), F.array(F.concat(F.lit("fix "), number)).alias("commit_messages"), (F.col("event_id") % 9).alias("score"), F.concat(F.lit('say "'), number).alias("title"), F.struct(F.lit("q").alias("z"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("user_id") % 5)).alias("labels")).alias("extra")).alias("metadata"), F.sha2("text", 256).alias("content_sha256"), F.struct(F.concat(F.lit("https://e.test/"), number).alias("url")).alias("provenance"),
    )
    path = shared_path(spark, "lines")
    e.select(F.to_json(row)).write.text(path)
    return read_jsonl(spark, path)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("event_key", "actor_key", "conversation_key", "parent_key", F.unix_micros("event_time").alias("us"), "text", F.array_join("context_ids", ",").alias("context"), F.array_join("commit_messages", ",").alias("messages"), "provenance_url")


def _archive(spark: SparkSession, sf_dir: str, quota: int = 2**31 - 1, rate: float = 0.0) -> tuple[DataFrame, dict[str, int]]:
    e = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    kind = F.element_at(F.lit(["IssuesEvent", "IssueCommentEvent", "PushEvent", "WatchEvent"]), (F.col("event_id") % 4 + 1).cast("int"))
    is_ = lambda name: kind == name
    issue = F.struct(F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("number"), F.concat(F.lit("delegate "), number).alias("title"), F.lit("see https://x.org/a").alias("body"), F.concat(F.lit("https://h/i"), number).alias("html_url"))
    comment = F.struct(F.col("event_id").alias("id"), F.concat(F.when(F.col("event_id") % 8 == 1, "heartbeat ").otherwise("nothing "), number).alias("body"), F.lit("").alias("html_url"))
    commit = F.struct(F.lit("s").alias("sha"), F.concat(F.lit("checkpoint "), number).alias("message"), F.concat(F.lit("https://a/"), number).alias("url"), F.struct(F.concat(F.lit("A@B"), F.col("user_id") % 3, F.lit(".Example")).alias("email")).alias("author"))
    payload = F.struct(F.when(is_("IssuesEvent") | is_("IssueCommentEvent"), issue).alias("issue"), F.when(is_("IssueCommentEvent"), comment).alias("comment"), F.when(is_("PushEvent"), F.array(commit)).alias("commits"))
    row = F.struct(number.alias("id"), kind.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.concat(F.lit("user"), "user_id").alias("login"), F.lit("User").alias("type")).alias("actor"), F.struct(F.lit("acme/widgets").alias("name")).alias("repo"), payload.alias("payload"))
    path = shared_path(spark, "archive")
    e.select(F.to_json(row)).write.option("compression", "gzip").text(path)
    return archive.read_archive(spark, path, archive.Limits(sample_rate=rate, max_observations=quota))


def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _archive(spark, sf_dir)
    return rows.select("source_event_id", "event_type", "text", "thread_id", "provenance_url", F.array_join("artifact_urls", ",").alias("urls"), F.array_join("commit_messages", ",").alias("messages"), F.array_join("email_domains", ",").alias("domains"), F.unix_micros("event_time").alias("us"))


def archive_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of an hour whose quotas cut both kinds."""
    _, counters = _archive(spark, sf_dir, quota=500, rate=1.0)
    return spark.createDataFrame([(k, int(n)) for k, n in counters.items()], "name string, n long")


def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns at rest, of observations as the reader gives them."""
    path = shared_path(spark, "sink")
    write_parquet(_lines(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("event_time", F.unix_micros("event_time"))


def new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return state.with_new_evidence(o.select("cluster_id").distinct(), o.select("cluster_id", "event_key"), o.filter("ingest_ord % 50 = 0"))


def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.score(spark, sf_dir).groupBy("confidence", "reviewable").agg(F.count("*").alias("clusters"))


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One semantic signal a cluster: verified exchanges, and rare signals that a calibration lifts."""
    k = F.floor(F.col("ingest_ord") / 12)
    o = observations(spark, sf_dir).withColumns({"cluster_id": F.concat(F.lit("s"), k), "k": k, "actor_raw": F.lower("actor")})
    none = F.array().cast("array<string>")
    one = o.select("cluster_id", "k").distinct().select(
        "cluster_id", F.lit("semantic").alias("family"), F.when(F.col("k") % 3 == 0, "rare_signal").otherwise("linked_coordination_exchange").alias("name"), ((80 + F.col("k") % 20) / 100).alias("score"), F.lit(1).alias("detector_ord"), F.lit(0).cast("long").alias("signal_ord"),
        none.alias("depends_on"), *[F.lit(False).alias(c) for c in ("longitudinal", "cross_resource", "exceptional")], (F.col("k") % 2).cast("int").alias("verified_native"), F.lit(0).alias("verified_cross"),
    )
    profile = scoring.CalibrationProfile({"rare_signal": 200.0, "linked_coordination_exchange": 50.0}, prior_probability=0.01)
    scores = scoring.score(one, scoring.cluster_facts(o), 0.60, profile)
    return scores.select("cluster_id", F.round("raw_score", 6).alias("score"), "confidence", "decision", "reviewable", F.col("evidence_log_likelihood_ratio").alias("log_lr"), F.round("posterior_probability", 6).alias("posterior"))


def forum_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments stand only under posts that fit the query."""
    number = F.col("doc_id").cast("string")
    place = (F.lit("tools").alias("subreddit"), F.lit("ann").alias("author"), F.lit("1767614400").alias("created_utc"))
    posts = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), number).alias("id"), *place, F.when(F.col("doc_id") % 3 == 0, "About Heartbeat").otherwise("other").alias("title"), F.lit("x").alias("selftext"), F.lit(1).cast("long").alias("score"), F.lit(0).cast("long").alias("num_comments"))
    body = F.when(F.col("toxic") == 1, "[removed]").when(F.col("quality") == 1, F.concat(F.lit("fine "), number)).otherwise("short")
    link = F.concat(F.lit("t3_p"), number)
    comments = table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), number).alias("id"), *place, body.alias("body"), link.alias("link_id"), link.alias("parent_id"), F.lit(1).cast("long").alias("score"))
    return feeds.forum_observations(posts, comments, "heartbeat OR worker").select("source_event_id", "event_type", "text", "parent_key", "conversation_key")


def repository_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that no fresh record of the ledger covers."""
    repos = observations(spark, sf_dir).select("repository").distinct()
    at = F.regexp_extract("repository", r"(\d+)$", 1).cast("int")
    checked = F.timestamp_seconds(F.lit(1767225600) + at * 43200)
    ledger = repos.filter(at % 2 == 0).select(F.upper("repository").alias("repository"), checked.alias("last_checked_at"))
    return state.allowed_repositories(repos, ledger, stale_days=3, continuous_owners=["ORG1"], now=datetime.fromisoformat("2026-01-08T00:00:00+00:00"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = detectors.graph_tables(clustered(spark, sf_dir))
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (code_blocks, cleaned_text, unnegated_acts, protocol_classes, redacted_notes, json_lines, archive_scan, archive_counters, parquet_sink, new_evidence, tier_histogram, calibrated_scores, forum_comments, repository_policy, graph_nodes)}
_WITH_NOTES = f"WITH notes AS ({_NOTES})"
ORACLES = {
    "code_blocks": f"{_WITH_NOTES} SELECT id, 'x = ' || id AS block FROM notes WHERE id % 8 = 0",
    "cleaned_text": f"""{_WITH_NOTES} SELECT id, CASE id % 8 WHEN 0 THEN 'intro' || chr(10) || chr(10) || 'outro' WHEN 1 THEN 'own words ' || id WHEN 2 THEN 'shown ' || id
      WHEN 5 THEN 'no  worries, task is complete ' || id ELSE text END AS cleaned FROM notes""",
    "unnegated_acts": f"{_WITH_NOTES} SELECT id, 'delegation' AS acts FROM notes WHERE id % 8 = 4",
    "protocol_classes": f"{_WITH_NOTES} SELECT id, CASE id % 8 WHEN 1 THEN 'acknowledgement' WHEN 3 THEN 'coordination_queue' ELSE 'machine_envelope' END AS classes FROM notes WHERE id % 8 IN (1, 3, 6)",
    "redacted_notes": f"{_WITH_NOTES} SELECT id, CASE WHEN id % 8 = 7 THEN 'token: [REDACTED] and [REDACTED] and [REDACTED]' ELSE text END AS text FROM notes",
    "json_lines": f"""{_WITH_NOTES} SELECT 'jsonl:event:jsonl:' || event_id AS event_key, 'jsonl:actor:user' || user_id AS actor_key, 'jsonl:repository:acme/w' || (user_id % 7) || ':thread:' || (user_id % 9) AS conversation_key,
      CASE WHEN event_id % 4 = 1 THEN 'jsonl:event:jsonl:' || (event_id - 1) END AS parent_key, epoch_us(ts) AS us, text, 'abc' || event_id AS context, 'fix ' || event_id AS messages, 'https://e.test/' || event_id AS provenance_url
      FROM events JOIN notes ON id = event_id""",
    "archive_scan": """SELECT CAST(event_id AS VARCHAR) AS source_event_id, CASE event_id % 4 WHEN 0 THEN 'IssuesEvent' WHEN 1 THEN 'IssueCommentEvent' ELSE 'PushEvent' END AS event_type,
        CASE event_id % 4 WHEN 0 THEN 'delegate ' || event_id || chr(10) || 'see https://x.org/a' WHEN 1 THEN 'heartbeat ' || event_id ELSE 'checkpoint ' || event_id END AS text,
        CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 50 AS VARCHAR) END AS thread_id, CASE WHEN event_id % 4 < 2 THEN 'https://h/i' ELSE 'https://a/' END || event_id AS provenance_url,
        CASE WHEN event_id % 4 = 0 THEN 'https://x.org/a' ELSE '' END AS urls, CASE WHEN event_id % 4 = 2 THEN 'checkpoint ' || event_id ELSE '' END AS messages,
        CASE WHEN event_id % 4 = 2 THEN 'b' || (user_id % 3) || '.example' ELSE '' END AS domains, epoch_us(date_trunc('second', ts)) AS us
      FROM events WHERE event_id % 4 IN (0, 2) OR event_id % 8 = 1""",
    "archive_counters": """WITH e AS (SELECT event_id % 4 < 3 AS listed, event_id % 4 IN (0, 2) OR event_id % 8 = 1 AS candidate FROM events),
      n AS (SELECT count(*) AS scanned, count_if(listed) AS relevant, count_if(listed AND candidate) AS c, count_if(listed AND NOT candidate) AS s FROM e),
      k AS (SELECT *, least(c, 400) AS kc, least(s, 100) AS ks FROM n)
      SELECT u.name, CAST(u.n AS BIGINT) AS n FROM k, LATERAL (VALUES ('events_scanned', scanned), ('relevant_events', relevant), ('repository_filtered_events', 0), ('malformed_events', 0), ('candidate_events', c), ('sampled_events', s),
        ('candidate_observations', kc), ('sampled_observations', ks), ('dropped_candidate_events', c - kc), ('dropped_sampled_events', s - ks), ('observations', kc + ks)) u(name, n)""",
    "parquet_sink": f"""{_WITH_NOTES} SELECT 'jsonl:event:jsonl:' || event_id AS event_key, 'jsonl' AS source, CAST(event_id AS VARCHAR) AS source_event_id, 'jsonl' AS platform, epoch_us(ts) AS event_time, 'jsonl:actor:user' || user_id AS actor_key,
      event_type, 'Acme/W' || (user_id % 7) AS repository, 'jsonl:repository:acme/w' || (user_id % 7) || ':thread:' || (user_id % 9) AS conversation_key, text, sha256(text) AS content_sha256,
      '{{"commit_messages":["fix ' || event_id || '"],"extra":{{"labels":["a","b' || (user_id % 5) || '"],"z":"q"}},"score":' || (event_id % 9) || ',"sha":"ABC' || event_id || '","title":"say \\"' || event_id || '"}}' AS metadata_json, 'https://e.test/' || event_id AS provenance_url
      FROM events JOIN notes ON id = event_id""",
    "new_evidence": with_obs("SELECT DISTINCT cluster_id FROM obs WHERE ingest_ord % 50 = 0"),
    "tier_histogram": f"SELECT confidence, reviewable, count(*) AS clusters FROM ({detection.ORACLES['score']}) GROUP BY 1, 2",
    "calibrated_scores": with_obs("""WITH f AS (SELECT CAST(floor(ingest_ord / 12) AS BIGINT) AS k, count(DISTINCT lower(actor)) >= 2 AND bool_and(provenance_url <> '') AS elig FROM obs GROUP BY 1),
      s AS (SELECT *, (80 + k % 20) / 100 AS score, k % 3 = 0 AS rare, CASE WHEN k % 3 = 0 THEN 200.0 ELSE 50.0 END AS lr FROM f),
      p AS (SELECT *, 0.01 / 0.99 * lr / (1 + 0.01 / 0.99 * lr) AS post, NOT rare AND score >= 0.90 AND k % 2 = 1 AS verified FROM s),
      t AS (SELECT *, greatest(0.52 * score, CASE WHEN rare THEN post ELSE 0 END, CASE WHEN verified THEN 0.80 ELSE 0 END) AS total FROM p),
      u AS (SELECT *, total >= 0.6 AND (verified OR rare) AND elig AS rev FROM t)
      SELECT 's' || k AS cluster_id, round(CAST(total AS DOUBLE), 6) AS score, CASE WHEN rev THEN 'high' ELSE 'low' END AS confidence, CASE WHEN rev THEN 'review' ELSE 'dismiss' END AS decision, rev AS reviewable,
        round(CAST(ln(lr) AS DOUBLE), 4) AS log_lr, round(CAST(post AS DOUBLE), 6) AS posterior FROM u"""),
    "forum_comments": """SELECT 'p' || doc_id AS source_event_id, 'submission' AS event_type, 'About Heartbeat' || chr(10) || chr(10) || 'x' AS text, CAST(NULL AS VARCHAR) AS parent_key, 'reddit:repository:reddit/r/tools:thread:p' || doc_id AS conversation_key FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT 'c' || doc_id, 'comment', CASE WHEN quality = 1 THEN 'fine ' || doc_id ELSE 'short' END, 'reddit:event:reddit:p' || doc_id, 'reddit:repository:reddit/r/tools:thread:p' || doc_id FROM labels WHERE toxic IS DISTINCT FROM 1 AND doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM documents)""",
    "repository_policy": with_obs("""WITH r AS (SELECT DISTINCT repository, CAST(regexp_extract(repository, '([0-9]+)$', 1) AS INTEGER) AS n FROM obs)
      SELECT repository FROM r WHERE NOT (n % 2 = 0 AND 1767225600 + n * 43200 > 1767830400 - 3 * 86400) OR repository LIKE 'Org1/%'"""),
    "graph_nodes": with_obs(f"""WITH {detection._C.format(by="cluster_id", us="us")}, {detection._ARTIFACTS} SELECT 'actor' AS kind, count(DISTINCT actor_key) AS n FROM c UNION ALL SELECT 'event', count(DISTINCT event_key) FROM c
      UNION ALL SELECT 'repository', count(DISTINCT repository) FROM c UNION ALL SELECT 'artifact', count(*) FROM (SELECT DISTINCT kind, value FROM uses)"""),
}
