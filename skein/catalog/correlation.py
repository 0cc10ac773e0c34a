"""Buckets, windows, sessions, links and trajectories over events and synthetic observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog.synthetic import observations, table, with_obs
from skein.operators import clustering
from skein.operators.features import with_features
from skein.scratch import written

#: What linking reads of the features.
_LINKING = ["bucket", "actor_key", "platform", "resource_key", "artifacts"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a bucket (k of the properties)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("event_key"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("bucket"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("ingest_ord"), "user_id")


def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = clustering.anchored_windows(_rows(spark, sf_dir), "bucket", 60)
    return w.select("event_key", F.concat("key", F.lit(":"), "window").alias("cluster_id"))


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clustering.sessions(_rows(spark, sf_dir), ["bucket"], 2)
    return s.groupBy("bucket", "session").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by Spark's own session windows (their gap is inclusive: two hours exactly still join)."""
    r = _rows(spark, sf_dir).withColumn("t", F.timestamp_micros("us"))
    g = r.groupBy("bucket", F.session_window("t", "7200001 milliseconds").alias("w")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return g.select("bucket", "n", "first_us", "last_us")


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.link_edges(with_features(observations(spark, sf_dir)))


def linked_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.linked_buckets(written(with_features(observations(spark, sf_dir)).select(*_LINKING), "features"))


def longitudinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.longitudinal(with_features(observations(spark, sf_dir)))
    return found.groupBy("kind_ord", "cluster_id").agg(F.count("*").alias("n"))


def thread_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all clusters: windows of linked buckets, then trajectories that are not one of them."""
    feats = with_features(observations(spark, sf_dir)).select("event_key", "us", "ingest_ord", *_LINKING, "all_credentials", "any_opaque", "scaffold")
    members = clustering.memberships(written(feats, "features"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("n"))


QUERIES = {
    "anchored_windows": anchored_windows,
    "gap_sessions": gap_sessions,
    "session_windows": session_windows,
    "link_edges": link_edges,
    "linked_buckets": linked_buckets,
    "longitudinal": longitudinal,
    "thread_clusters": thread_clusters,
}
_EVENTS = "SELECT CAST(event_id AS VARCHAR) AS event_key, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS bucket, epoch_us(ts) AS us, event_id AS o, user_id FROM events"
_SESSIONS = f"""WITH r AS ({_EVENTS}), g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY bucket ORDER BY us, o)),
  s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY bucket ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session FROM g)"""
_USES = """uses AS (SELECT DISTINCT event_key, actor_key, platform, resource_key, coalesce(conversation_key, resource_key, event_key) AS bucket, kind, value FROM (
    SELECT *, 'marker:task_id' AS kind, 'alpha-' || th AS value FROM obs WHERE text LIKE '%task_id=alpha-%'
    UNION ALL SELECT *, 'marker:checkpoint', regexp_extract(text, 'checkpoint=(ckpt-[0-9]+-state)', 1) FROM obs WHERE text LIKE '%checkpoint=ckpt-%')),
  scope AS (SELECT kind, value FROM uses GROUP BY kind, value HAVING count(DISTINCT bucket) BETWEEN 2 AND 10 AND count(DISTINCT actor_key) >= 2 AND (count(DISTINCT platform) >= 2 OR count(DISTINCT resource_key) >= 2)),
  held AS (SELECT DISTINCT kind, value, bucket FROM uses JOIN scope USING (kind, value)),
  edges AS (SELECT h.kind, h.value, m.a, h.bucket AS b FROM held h JOIN (SELECT kind, value, min(bucket) AS a FROM held GROUP BY 1, 2) m USING (kind, value) WHERE h.bucket <> m.a)"""
_LINKED = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS v, a AS u FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON e.a = r.u),
  comp AS (SELECT v, list_sort(list(DISTINCT u)) AS keys FROM reach GROUP BY v), linked AS (SELECT v AS bucket, 'linked:' || substring(sha256(array_to_string(keys, chr(10))), 1, 20) AS cluster_key FROM comp)"""
_LONG = """la AS (SELECT actor_key FROM obs GROUP BY actor_key HAVING max(us) - min(us) >= 129600000000 AND count(*) >= 10 AND count(DISTINCT resource_key) >= 2),
  lr AS (SELECT resource_key FROM obs GROUP BY resource_key HAVING max(us) - min(us) >= 129600000000 AND count(*) >= 16 AND count(DISTINCT actor_key) >= 2),
  lc AS (SELECT *, regexp_extract(text, 'session-[A-Za-z0-9]+', 0) AS cred FROM obs WHERE text LIKE 'session-%'),
  lk AS (SELECT cred FROM lc GROUP BY cred HAVING count(*) >= 4 AND count(DISTINCT actor_key) >= 2 AND count(DISTINCT resource_key) >= 2),
  lq AS (SELECT event_key FROM (SELECT event_key, ch, count(*) AS k FROM (SELECT event_key, unnest(string_split(regexp_extract(text, '[a-z0-9]{64}'), '')) AS ch FROM lc) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 14 AND -sum(k / 64 * log2(k / 64)) / 5.2 >= 0.72),
  ln AS (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, ingest_ord) > 7200000000 THEN 1 ELSE 0 END AS new FROM lc WHERE event_key IN (SELECT event_key FROM lq)),
  ls AS (SELECT *, sum(new) OVER (ORDER BY us, ingest_ord ROWS UNBOUNDED PRECEDING) AS session FROM ln),
  lo AS (SELECT session, 'trajectory:opaque:' || substring(sha256('session-abcdef<number> <opaque>'), 1, 10) || ':' || session || ':' || substring(sha256(string_agg(event_key, chr(10) ORDER BY event_key)), 1, 12) AS cluster_id
    FROM ls GROUP BY session HAVING count(*) >= 6 AND count(DISTINCT actor_key) >= 2),
  long AS (SELECT 1 AS kind_ord, 'trajectory:actor:' || substring(sha256(actor_key), 1, 16) AS cluster_id, event_key FROM obs JOIN la USING (actor_key)
    UNION ALL SELECT 2, 'trajectory:resource:' || substring(sha256(resource_key), 1, 16), event_key FROM obs JOIN lr USING (resource_key)
    UNION ALL SELECT 3, 'trajectory:credential:' || substring(sha256(cred), 1, 16), event_key FROM lc JOIN lk USING (cred)
    UNION ALL SELECT 4, lo.cluster_id, event_key FROM ls JOIN lo USING (session))"""
ORACLES = {
    "anchored_windows": f"""WITH RECURSIVE r AS ({_EVENTS}),
      a AS (SELECT bucket, min(us) AS us, 0 AS n FROM r GROUP BY bucket
        UNION ALL SELECT x.bucket, x.us, x.n FROM (SELECT a.bucket, min(r.us) AS us, a.n + 1 AS n FROM a JOIN r ON r.bucket = a.bucket AND r.us > a.us + 3600000000 GROUP BY a.bucket, a.n) x)
      SELECT r.event_key, r.bucket || ':' || max(a.n) AS cluster_id FROM r JOIN a ON a.bucket = r.bucket AND a.us <= r.us GROUP BY r.event_key, r.bucket""",
    "gap_sessions": f"{_SESSIONS} SELECT bucket, session, count(*) AS n, count(DISTINCT user_id) AS users, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2",
    "session_windows": f"{_SESSIONS} SELECT bucket, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY bucket, session",
    "link_edges": with_obs(f"WITH {_USES} SELECT kind, value, a, b FROM edges"),
    "linked_buckets": with_obs(f"WITH {_USES}, {_LINKED} SELECT bucket, cluster_key FROM linked"),
    "longitudinal": with_obs(f"WITH {_LONG} SELECT kind_ord, cluster_id, count(*) AS n FROM long GROUP BY 1, 2"),
    "thread_clusters": with_obs(f"""WITH {_USES}, {_LINKED}, {_LONG},
      keyed AS (SELECT event_key, us, coalesce(cluster_key, b.bucket) AS key FROM (SELECT event_key, us, coalesce(conversation_key, resource_key, event_key) AS bucket FROM obs) b LEFT JOIN linked USING (bucket)),
      opened AS (SELECT key, min(us) AS us, 0 AS n FROM keyed GROUP BY key
        UNION ALL SELECT x.key, x.us, x.n FROM (SELECT a.key, min(r.us) AS us, a.n + 1 AS n FROM opened a JOIN keyed r ON r.key = a.key AND r.us > a.us + 3600000000 GROUP BY a.key, a.n) x),
      windows AS (SELECT k.event_key, k.key || ':' || max(o.n) AS cluster_id FROM keyed k JOIN opened o ON o.key = k.key AND o.us <= k.us GROUP BY k.event_key, k.key),
      every AS (SELECT 0 AS kind_ord, cluster_id, event_key FROM windows UNION ALL SELECT kind_ord, cluster_id, event_key FROM long),
      sets AS (SELECT kind_ord, cluster_id, count(*) AS n, string_agg(event_key, ',' ORDER BY event_key) AS keys FROM every GROUP BY 1, 2)
      SELECT cluster_id, n FROM sets QUALIFY kind_ord = 0 OR row_number() OVER (PARTITION BY keys ORDER BY kind_ord, cluster_id) = 1"""),
}
