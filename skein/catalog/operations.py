"""State and reporting operations: latest rows, claims, quotas, rollups, joins of alerts, health counts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog.synthetic import observations, table, with_obs
from skein.functions import text as X
from skein.history import History
from skein.operators import state
from skein.scratch import shared_path
from skein.sources import archive


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("u"), "user_id"))
    old = e.filter("event_id % 2 = 0").groupBy("key").agg(F.max_by(F.struct("event_id", "ts", "value"), F.col("event_id")).alias("r")).select("key", "r.*")
    new = e.filter("event_id % 2 = 1").select("key", "event_id", "ts", "value")
    return state.upsert_latest(old, new, "key", "event_id").select("key", "event_id", F.round("value", 6).alias("value"))


def fingerprint_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = e.filter("event_id % 10 = 0").select(F.sha2(F.col("user_id").cast("string"), 256).alias("fingerprint"))
    found = e.select(F.sha2(F.concat_ws(":", "user_id", F.col("event_id") % 3), 256).alias("fingerprint"), F.col("event_id").alias("first_seen")).union(e.select(F.sha2(F.col("user_id").cast("string"), 256), F.col("event_id")))
    return state.claim_fingerprints(known, found)


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("event_key", F.col("ingest_ord").alias("line_no"), X.has(F.col("text"), X.CANDIDATE).alias("candidate"))
    return archive.within_quotas(o, archive.Limits(max_observations=1000)).filter("retained").select("event_key", "candidate")


def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    scores = o.groupBy("cluster_id").agg((F.count("*") % 10 / 10.0).alias("score")).withColumn("reviewable", F.col("score") >= 0.7)
    out = state.ledger_rollup(o.select("cluster_id", "repository"), o, scores)
    return out.select("repository", "observations", F.unix_micros("last_event_time").alias("last_us"), "max_score", "status")


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger at a shared address, written for all repositories and again for some of them, as it is read back."""
    o = observations(spark, sf_dir)
    scores = o.groupBy("cluster_id").agg((F.count("*") % 10 / 10.0).alias("score")).withColumn("reviewable", F.col("score") >= 0.7)
    rollup = state.ledger_rollup(o.select("cluster_id", "repository"), o, scores)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "ledger"))
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    state.write_ledger(rollup, root, ["first"], "1", datetime(2026, 1, 1, tzinfo=UTC))
    state.write_ledger(rollup.filter("observations % 2 = 0"), root, ["first", "second"], "2", datetime(2026, 1, 2, tzinfo=UTC))
    us = lambda c: F.unix_micros(c).alias(c.replace("_at", "_us").replace("_time", "_us"))
    return state.read_ledger(spark, root).select("repository", us("last_checked_at"), us("last_event_time"), "query_version", "detector_version", "observations", "max_score", "status")


def alert_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("alert_id"), "quality", "toxic")
    return state.findings(alerts, reviews)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("event_time", F.col("ts"))
    out = state.health(e, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return out.select("name", "rows", F.unix_micros(F.col("oldest").cast("timestamp")).alias("oldest_us"), F.unix_micros(F.col("newest").cast("timestamp")).alias("newest_us"))


def alert_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.alert_fingerprints(observations(spark, sf_dir))


def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is put three times over: what each key says now, and whether it is among the newest thousand."""
    rows = observations(spark, sf_dir).select("event_key", "repository", F.col("ingest_ord").alias("e"), "event_time")
    held = History(shared_path(spark, "history"), "event_key", "event_time")
    held.put(rows.withColumn("version", F.lit(1)))
    held.put(rows.filter("e % 3 = 0").withColumns({"version": F.lit(2), "event_time": F.expr("event_time + INTERVAL 1 DAY")}))
    held.compact(spark)
    held.put(rows.filter("e % 5 = 0").withColumns({"version": F.lit(3), "note": F.concat(F.lit("late "), "e")}))
    newest = held.newest(spark, 1000).select("event_key", F.lit(True).alias("newest"))
    out = held.rows(spark).join(newest, "event_key", "left")
    return out.select("event_key", "repository", "version", "note", F.unix_micros("event_time").alias("us"), F.coalesce("newest", F.lit(False)).alias("newest"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    scores = o.groupBy("cluster_id").agg((F.count("*") * 37 % 100 / 100.0).alias("score")).withColumn("reviewable", F.col("score") >= 0.9)
    return state.watchlist(scores, 5)


QUERIES = {
    "upsert_latest": upsert_latest,
    "fingerprint_claim": fingerprint_claim,
    "quotas": quotas,
    "ledger_rollup": ledger_rollup,
    "ledger_table": ledger_table,
    "alert_reviews": alert_reviews,
    "health": health,
    "alert_fingerprints": alert_fingerprints,
    "history_newest": history_newest,
    "watchlist": watchlist,
}
ORACLES = {
    "upsert_latest": """WITH e AS (SELECT 'u' || user_id AS key, event_id, value, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS new FROM events)
      SELECT key, event_id, round(value, 6) AS value FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY new DESC, event_id DESC) = 1""",
    "fingerprint_claim": """WITH f AS (SELECT sha256(user_id || ':' || (event_id % 3)) AS fingerprint, event_id FROM events UNION ALL SELECT sha256(CAST(user_id AS VARCHAR)), event_id FROM events)
      SELECT fingerprint, min(event_id) AS first_seen FROM f WHERE fingerprint NOT IN (SELECT sha256(CAST(user_id AS VARCHAR)) FROM events WHERE event_id % 10 = 0) GROUP BY 1""",
    "quotas": with_obs("""WITH q AS (SELECT event_key, ingest_ord, regexp_matches(text, '(?i)(?:task[_ -]?id|worker[_ -]?id|resume[_ -]?token|continuation[_ -]?token|checkpoint|nonce|delegate|coordinator|heartbeat)') AS candidate FROM obs)
      SELECT event_key, candidate FROM q QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY ingest_ord) <= CASE WHEN candidate THEN 800 ELSE 200 END"""),
    "ledger_rollup": with_obs("""WITH s AS (SELECT cluster_id, count(*) % 10 / 10.0 AS score FROM obs GROUP BY 1), m AS (SELECT DISTINCT repository, cluster_id FROM obs)
      , best AS (SELECT repository, max(score) AS max_score FROM m JOIN s USING (cluster_id) GROUP BY 1), own AS (SELECT repository, count(*) AS observations, max(us) AS last_us FROM obs GROUP BY 1)
      SELECT repository, observations, last_us, CAST(max_score AS DOUBLE) AS max_score, CASE WHEN max_score >= 0.7 THEN 'high_confidence' ELSE 'no_high_confidence' END AS status FROM own JOIN best USING (repository)"""),
    "ledger_table": with_obs("""WITH s AS (SELECT cluster_id, count(*) % 10 / 10.0 AS score FROM obs GROUP BY 1), m AS (SELECT DISTINCT repository, cluster_id FROM obs)
      , best AS (SELECT repository, max(score) AS max_score FROM m JOIN s USING (cluster_id) GROUP BY 1), own AS (SELECT repository, count(*) AS n, max(us) AS last_event_us FROM obs GROUP BY 1)
      SELECT repository, CASE WHEN n % 2 = 0 THEN 1767312000000000 ELSE 1767225600000000 END AS last_checked_us, last_event_us, sha256(CASE WHEN n % 2 = 0 THEN 'first' || chr(10) || 'second' ELSE 'first' END) AS query_version,
        CASE WHEN n % 2 = 0 THEN '2' ELSE '1' END AS detector_version, CAST(n AS INTEGER) AS observations, CAST(max_score AS DOUBLE) AS max_score, CASE WHEN max_score >= 0.7 THEN 'high_confidence' ELSE 'no_high_confidence' END AS status
      FROM own JOIN best USING (repository)"""),
    "alert_reviews": "SELECT d.doc_id AS id, source, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "health": """SELECT 'observations' AS name, count(*) AS rows, epoch_us(min(ts)) AS oldest_us, epoch_us(max(ts)) AS newest_us FROM events
      UNION ALL SELECT 'documents', count(*), NULL, NULL FROM documents UNION ALL SELECT 'labels', count(*), NULL, NULL FROM labels""",
    "alert_fingerprints": with_obs("SELECT cluster_id, sha256(string_agg(provenance_url, chr(10) ORDER BY provenance_url)) AS fingerprint FROM obs GROUP BY 1"),
    "history_newest": with_obs("""WITH v AS (SELECT event_key, repository, ingest_ord AS e, us, CASE WHEN ingest_ord % 5 = 0 THEN 3 WHEN ingest_ord % 3 = 0 THEN 2 ELSE 1 END AS version FROM obs),
      t AS (SELECT event_key, repository, CAST(version AS INTEGER) AS version, CASE WHEN version = 3 THEN 'late ' || e END AS note, us + CASE WHEN version = 2 THEN 86400000000 ELSE 0 END AS us FROM v)
      SELECT *, row_number() OVER (ORDER BY us DESC, event_key) <= 1000 AS newest FROM t"""),
    "watchlist": with_obs("""WITH s AS (SELECT cluster_id, CAST(count(*) * 37 % 100 / 100.0 AS DOUBLE) AS score FROM obs GROUP BY 1)
      SELECT cluster_id, score, false AS reviewable FROM s WHERE score < 0.9 AND score > 0 ORDER BY score DESC, cluster_id LIMIT 5"""),
}
