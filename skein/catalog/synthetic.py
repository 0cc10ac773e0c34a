"""Observations made from the ``events`` table, by one SQL text that both engines run.

Events of the same half hour form a thread; an event's number decides what it says, so that every detector has rows to
find and rows to leave alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.features import with_features

_OBS = """
SELECT
  'events' AS source, CAST(e AS {text}) AS source_event_id, platform,
  platform || ':event:events:' || e AS event_key, actor, platform || ':actor:' || lower(actor) AS actor_key,
  CASE WHEN th % 5 = 0 THEN 'PushEvent' ELSE 'IssueCommentEvent' END AS event_type, us, say AS text, repository,
  platform || ':repository:' || lower(repository) AS resource_key,
  CASE WHEN th % 5 = 0 THEN NULL ELSE platform || ':repository:' || lower(repository) || ':thread:' || th END AS conversation_key,
  CASE WHEN th % 3 = 0 AND th % 5 <> 0 AND prev IS NOT NULL THEN platform || ':event:events:' || prev END AS parent_key,
  CASE WHEN r = 6 THEN 'https://ex' || (th % 9) || '.example.org/p?b=' || (th % 50) || '&utm_source=x#top' END AS url,
  CASE WHEN user_id % 10 = 0 THEN 'Bot' END AS actor_type,
  CASE WHEN th % 5 = 0 THEN 'Update file ' || (e % 900) END AS commit_message,
  CASE WHEN th % 5 = 0 THEN CASE WHEN th % 2 = 0 THEN 'users.noreply.github.com' ELSE 'corp' || (th % 3) || '.example' END END AS email_domain,
  CASE WHEN th % 97 = 0 THEN '' ELSE 'https://example.org/e/' || e END AS provenance_url,
  e AS ingest_ord, th, 'c' || th AS cluster_id
FROM (
  SELECT *, lag(e) OVER (PARTITION BY th ORDER BY us, e) AS prev,
    CASE WHEN th % 11 = 0 THEN 'reddit' ELSE 'github' END AS platform,
    CASE WHEN user_id % 10 = 0 THEN 'ci-bot-' || user_id ELSE 'User' || user_id END AS actor,
    'Org' || (th % 7) || '/repo' || (th % 23) AS repository,
    CASE r
      WHEN 0 THEN 'Please run the job. task_id=alpha-' || th
      WHEN 1 THEN 'ACK task_id=alpha-' || th || ' retry_count=2'
      WHEN 2 THEN CASE WHEN user_id % 10 = 0 THEN 'Bump dependency foo, auto-generated' ELSE 'heartbeat from worker ' || user_id END
      WHEN 3 THEN 'Task complete, returning result: task_id=alpha-' || th
      WHEN 4 THEN 'checkpoint saved. checkpoint=ckpt-' || half || '-state'
      WHEN 5 THEN 'resuming from checkpoint=ckpt-' || half || '-state'
      WHEN 6 THEN 'fingerprint: AB:CD:' || (th % 30) || ':99 and release notes for v1.2.' || (th % 4)
      ELSE CASE WHEN th % 2 = 0 THEN '# Plan for the step ' || (th % 3) || ' of our work' ELSE 'session-abcdef0123456789' || (th % 40) || ' ' || {sha} END
    END AS say
  FROM (SELECT event_id AS e, event_id % 8 AS r, user_id, {us} AS us, CAST(floor({us} / 1800000000.0) AS BIGINT) AS th, CAST(floor({us} / 3600000000.0) AS BIGINT) AS half FROM events))
"""
SPARK_SQL = _OBS.format(text="STRING", us="unix_micros(CAST(ts AS TIMESTAMP))", sha="sha2(CAST(e AS STRING), 256)")
DUCK_SQL = _OBS.format(text="VARCHAR", us="epoch_us(ts)", sha="sha256(CAST(e AS VARCHAR))")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the SQL text."""
    return spark.sql(SPARK_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as canonical observations (with th and cluster_id)."""
    none = F.array().cast("array<string>")
    one = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.array(c))
    return raw(spark, sf_dir).withColumns(
        {
            "event_time": F.timestamp_micros("us"),
            "artifact_urls": one("url"),
            "code_blocks": none,
            "context_ids": none,
            "app_slug": F.lit(None).cast("string"),
            "commit_messages": one("commit_message"),
            "email_domains": one("email_domain"),
            "content_sha256": F.sha2("text", 256),
            "thread_id": F.col("th").cast("string"),
        }
    )


def clustered(spark: SparkSession, sf_dir: str, by: str = "cluster_id", us: str = "us") -> DataFrame:
    """Features with a given clustering (by thread, or any SQL expression) and a given clock."""
    return with_features(observations(spark, sf_dir)).withColumn("cluster_id", F.expr(by)).withColumn("us", F.expr(us))


def with_obs(sql: str) -> str:
    """Oracle SQL over the view ``obs``."""
    sql = sql.strip()
    return f"WITH RECURSIVE obs AS ({DUCK_SQL}), {sql[4:].lstrip()}" if sql.startswith("WITH") else f"WITH obs AS ({DUCK_SQL}) {sql}"
