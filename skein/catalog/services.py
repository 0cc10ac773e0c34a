"""Payloads of public services, made from events, as observations; and functions that only such payloads reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog.synthetic import observations, table, with_obs
from skein.functions import text as X
from skein.operators import detectors, state
from skein.sources import archive, feeds

#: Payload columns in one SQL text that both engines run; ``made`` is the event's time to the second.
_ITEMS = """
SELECT event_id AS id, event_id % 50 AS number, 't' || event_id AS title, CASE WHEN event_id % 3 > 0 THEN 'see https://x.org/' || event_id END AS body,
  'https://h/' || event_id AS html_url, CASE WHEN event_id % 7 > 0 THEN 'https://api.github.com/repos/Acme/w' || (event_id % 9) ELSE '' END AS repository_url,
  'u' || user_id AS login, event_id % 10 AS r, event_id - event_id % 10 AS root, {at} AS made FROM events
"""
_SPARK_ITEMS = _ITEMS.format(at="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").replace("FROM events", "FROM {events}")
_WITH_ITEMS = f"WITH items AS ({_ITEMS.format(at='epoch_us(date_trunc(' + chr(39) + 'second' + chr(39) + ', ts))')})"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.struct(F.col("login"), F.lit("User").alias("type")).alias("user")
    return spark.sql(_SPARK_ITEMS, events=table(spark, sf_dir, "events")).withColumn("user", user)


def _fields(schema: str, spark: SparkSession, rows: DataFrame, **given) -> DataFrame:
    """``rows`` with exactly the fields of ``schema``, null where neither they nor ``given`` have them."""
    shape = spark.createDataFrame([], schema).schema
    return rows.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pull = F.when(F.col("r") == 0, F.struct(F.lit("u").alias("url")))
    rows = _fields(feeds.ISSUE, spark, _items(spark, sf_dir), created_at=F.col("made"), state=F.lit("open"), pull_request=pull, labels=F.array(F.struct(F.lit("bug").alias("name"))), comments=F.col("number"))
    got = feeds.issue_observations(rows)
    return got.select("source_event_id", "actor", "event_type", "text", "repository", "thread_id", F.unix_micros("event_time").alias("us"), F.array_join("artifact_urls", ",").alias("urls"), "provenance_url", "metadata_json")


def thread_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of an issue, or every second time a pull request, with two comments of four and their review comments."""
    items = _items(spark, sf_dir)
    pull = F.when(F.col("id") % 20 == 0, F.struct(F.lit("u").alias("url")))
    roots = _fields(feeds.ROOT, spark, items.filter("r = 0"), created_at=F.col("made"), pull_request=pull, repository_url=F.concat(F.lit("https://api.github.com/repos/Acme/w"), F.col("id") % 9))
    held = f"{feeds.COMMENT}, root_id long"
    said = _fields(held, spark, items.filter("r BETWEEN 1 AND 4"), created_at=F.col("made"), root_id=F.col("root"))
    reviews = _fields(held, spark, items.filter("r BETWEEN 5 AND 8"), created_at=F.col("made"), root_id=F.col("root"), in_reply_to_id=F.when(F.col("r") > 5, F.col("id") - 1), path=F.lit("a.py"))
    got = feeds.thread_observations(roots, said, reviews, 2)
    return got.select("source_event_id", "event_type", "text", "repository", "conversation_key", "parent_key", "metadata_json")


def snippet_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("id").cast("string")
    hits = _items(spark, sf_dir).select(F.concat(F.lit("Acme/w"), F.col("r")).alias("repo"), F.concat(F.lit("a"), number, F.lit(".py")).alias("path"), F.concat(F.lit("<tr><td>x</td></tr> &lt; &#39;"), number, F.lit("&#x27; &amp;amp; &eacute; ")).alias("snippet"))
    got = feeds.snippet_observations(hits, "delegate")
    return got.select("source_event_id", "actor", "text", F.array_join("code_blocks", "|").alias("blocks"), "repository", "provenance_url", "metadata_json")


def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.lit(["CreateEvent", "PullRequestEvent", "IssuesEvent", "WatchEvent"]), (F.col("id") % 4 + 1).cast("int"))
    issue = F.struct("id", "number", "title", "body", "html_url")
    payload = F.struct(F.lit("opened").alias("action"), F.when(kind == "IssuesEvent", issue).alias("issue"), F.when(kind == "PullRequestEvent", issue).alias("pull_request"), F.when(kind == "CreateEvent", F.lit("branch")).alias("ref_type"), F.when(kind == "CreateEvent", F.concat(F.lit("b"), "id")).alias("ref"))
    rows = _items(spark, sf_dir).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), kind.alias("type"), F.col("made").alias("created_at"), F.col("user").alias("actor"), F.struct(F.lit("Acme/w").alias("name")).alias("repo"), payload.alias("payload"))).alias("raw"))
    got = feeds.event_observations(rows.select(F.from_json("raw", archive.EVENT).alias("e")).select("e.*"))
    return got.select("source", "source_event_id", "event_key", "event_type", "text", "thread_id", F.unix_micros("event_time").alias("us"), "content_sha256", "provenance_url", "metadata_json")


def archive_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, as texts, code blocks and addresses, cut to an hour's limits."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "text", F.array_repeat("text", 6).alias("code_blocks"), F.array_repeat(F.concat(F.lit("http://"), F.coalesce("text", F.lit(""))), 25).alias("artifact_urls"))
    got = archive.truncated(rows, archive.Limits(max_text_chars=1000))
    last = lambda c: F.sha2(F.coalesce(F.element_at(c, -1), F.lit("")), 256)
    return got.select("doc_id", "text_truncated", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.size("code_blocks").alias("blocks"), last("code_blocks").alias("block"), F.size("artifact_urls").alias("urls"), last("artifact_urls").alias("url"))


def code_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("  \n def step_"), "id", F.lit("(value):   \n\treturn value + "), "id", F.lit(" \t\r\n"), F.repeat(F.lit("pass # more;  "), (F.col("r") + 2).cast("int")), F.lit("\n\n"))
    few = F.repeat(F.lit("ab "), 60)
    return _items(spark, sf_dir).select("id", X.canonical_code(F.when(F.col("number") == 0, few).otherwise(code)).alias("digest"))


def artifact_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that look like UUIDs or hashes weigh less than other markers; eight events make a cluster."""
    k = F.floor(F.col("id") / 8)
    digest = F.sha2(k.cast("string"), 256)
    cut = lambda a, n: F.substring(digest, a, n)
    uuid = F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(13, 3), F.lit("-a"), cut(16, 3), F.lit("-"), cut(19, 12))
    value = F.when(k % 4 == 0, uuid).when(k % 4 == 1, F.substring(digest, 1, 12)).when(k % 4 == 2, F.concat(F.lit("job-"), k)).otherwise(F.concat(cut(1, 8), F.lit("-"), cut(9, 4)))
    rows = _items(spark, sf_dir).select(F.concat(F.lit("c"), k).alias("cluster_id"), F.concat(F.lit("a"), F.col("id") % 2).alias("actor_key"), F.col("id").cast("string").alias("event_key"), F.concat(F.lit("t"), F.col("id") % 3).alias("conversation_key"), F.lit(None).cast("string").alias("resource_key"), F.array(F.struct(F.lit("marker:task").alias("kind"), value.alias("value"))).alias("artifacts"))
    return detectors.artifact_reuse(rows).select("cluster_id", F.round("score", 6).alias("score"), F.element_at("evidence", 1).alias("line"), F.size("observation_ids").alias("ids"))


def newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 observations of four repositories."""
    return state.of_repositories(observations(spark, sf_dir), ["Org1/repo1", "Org2/repo2", "Org3/repo3", "Org1/repo8"], 100).select("event_key", "repository", "us")


QUERIES = {f.__name__: f for f in (issue_search, thread_expansion, snippet_hits, public_events, archive_truncations, code_digests, artifact_shapes, newest_history)}
ORACLES = {
    "issue_search": f"""{_WITH_ITEMS} SELECT 'issue:' || id AS source_event_id, login AS actor, CASE WHEN r = 0 THEN 'pull_request' ELSE 'issue' END AS event_type, concat_ws(chr(10) || chr(10), title, body) AS text,
      nullif(regexp_extract(repository_url, '/repos/(.+)$', 1), '') AS repository, CAST(number AS VARCHAR) AS thread_id, made AS us, CASE WHEN body IS NULL THEN '' ELSE 'https://x.org/' || id END AS urls, html_url AS provenance_url,
      '{{"actor_type":"User","author_association":null,"comments":' || number || ',"labels":["bug"],"number":' || number || ',"state":"open"}}' AS metadata_json FROM items""",
    "thread_expansion": f"""{_WITH_ITEMS}, threads AS (SELECT id AS root, number, 'Acme/w' || (id % 9) AS repository, id % 20 = 0 AS pull FROM items WHERE r = 0),
      ranked AS (SELECT i.*, t.number AS thread, t.repository, t.pull, row_number() OVER (PARTITION BY i.root, i.r > 4 ORDER BY made, id) AS n FROM items i JOIN threads t ON t.root = i.root WHERE i.r BETWEEN 1 AND 8)
      SELECT 'issue:' || id AS source_event_id, CASE WHEN id % 20 = 0 THEN 'pull_request' ELSE 'issue' END AS event_type, concat_ws(chr(10) || chr(10), title, body) AS text, 'Acme/w' || (id % 9) AS repository,
        'github:repository:acme/w' || (id % 9) || ':thread:' || number AS conversation_key, CAST(NULL AS VARCHAR) AS parent_key, '{{"actor_type":"User","author_association":null,"number":' || number || ',"root":true,"state":null}}' AS metadata_json FROM items WHERE r = 0
      UNION ALL SELECT 'comment:' || id, 'issue_comment', coalesce(body, ''), repository, 'github:repository:' || lower(repository) || ':thread:' || thread, NULL,
        '{{"actor_type":"User","author_association":null,"conversation_root":"issue:' || root || '","github_app_slug":null,"issue_number":' || thread || ',"root":false}}' FROM ranked WHERE r <= 4 AND n <= 2
      UNION ALL SELECT 'review-comment:' || id, 'pull_request_review_comment', coalesce(body, ''), repository, 'github:repository:' || lower(repository) || ':thread:' || thread, CASE WHEN r > 5 THEN 'github:event:github-thread-search:review-comment:' || (id - 1) END,
        '{{"actor_type":"User","author_association":null,"conversation_root":"issue:' || root || '","github_app_slug":null,"path":"a.py","pull_request_number":' || thread || '}}' FROM ranked WHERE r > 4 AND n <= 2 AND pull""",
    "snippet_hits": f"""{_WITH_ITEMS}, s AS (SELECT *, 'Acme/w' || r AS repo, 'a' || id || '.py' AS path, 'x < ''' || id || ''' &amp; ' || chr(233) AS content FROM items), t AS (SELECT *, repo || ':' || path || chr(10) || content AS text FROM s)
      SELECT 'grep:' || sha256(text) AS source_event_id, 'Acme' AS actor, text, content AS blocks, repo AS repository, 'https://github.com/' || repo || '/blob/HEAD/' || path AS provenance_url, '{{"experimental":true,"path":"' || path || '","query":"delegate"}}' AS metadata_json FROM t""",
    "public_events": f"""{_WITH_ITEMS}, e AS (SELECT *, ['CreateEvent', 'PullRequestEvent', 'IssuesEvent', 'WatchEvent'][id % 4 + 1] AS kind FROM items), t AS (SELECT *, CASE WHEN kind = 'CreateEvent' THEN 'branch' || chr(10) || 'b' || id ELSE concat_ws(chr(10), title, body) END AS text FROM e WHERE kind <> 'WatchEvent')
      SELECT 'github-events' AS source, CAST(id AS VARCHAR) AS source_event_id, 'github:event:github-events:' || id AS event_key, kind AS event_type, text, CASE WHEN kind <> 'CreateEvent' THEN CAST(number AS VARCHAR) END AS thread_id, made AS us, sha256(text) AS content_sha256,
        CASE WHEN kind = 'CreateEvent' THEN 'https://github.com/Acme/w' ELSE html_url END AS provenance_url, '{{"actor_type":"User","payload_action":"opened","public":true}}' AS metadata_json FROM t""",
    "archive_truncations": """SELECT doc_id, coalesce(length(text) > 1000, false) AS text_truncated, sha256(coalesce(text[:1000], '')) AS text, CAST(4 AS INTEGER) AS blocks, sha256(coalesce(text[:4096], '')) AS block, CAST(20 AS INTEGER) AS urls, sha256(('http://' || coalesce(text, ''))[:2048]) AS url FROM documents""",
    "code_digests": f"""{_WITH_ITEMS}, c AS (SELECT id, number, 'def step_' || id || '(value):' || chr(10) || chr(9) || 'return value + ' || id || chr(10) || rtrim(repeat('pass # more;  ', CAST(r + 2 AS INTEGER))) AS code FROM items)
      SELECT id, CASE WHEN number > 0 AND length(code) >= 120 THEN sha256(code) END AS digest FROM c""",
    "artifact_shapes": f"""{_WITH_ITEMS}, k AS (SELECT id, CAST(floor(id / 8) AS BIGINT) AS k FROM items), h AS (SELECT *, sha256(CAST(k AS VARCHAR)) AS h FROM k),
      v AS (SELECT id, k, CASE k % 4 WHEN 0 THEN h[1:8] || '-' || h[9:12] || '-4' || h[13:15] || '-a' || h[16:18] || '-' || h[19:30] WHEN 1 THEN h[1:12] WHEN 2 THEN 'job-' || k ELSE h[1:8] || '-' || h[9:12] END AS value FROM h),
      g AS (SELECT k, value, count(*) AS n, count(DISTINCT id % 2) AS actors, count(DISTINCT id % 3) AS contexts FROM v GROUP BY 1, 2 HAVING count(DISTINCT id % 2) >= 2)
      SELECT 'c' || k AS cluster_id, round(CAST(least(0.98, least(0.95, CASE WHEN k % 4 < 2 THEN 0.58 ELSE 0.82 END + 0.08 * (contexts - 1)) + 0.04 * (actors - 2)) AS DOUBLE), 6) AS score,
        'marker:task:sha256=' || sha256(value)[:16] || ':actors=' || actors || ':contexts=' || contexts AS line, CAST(n AS INTEGER) AS ids FROM g""",
    "newest_history": with_obs("SELECT event_key, repository, us FROM obs WHERE repository IN ('Org1/repo1', 'Org2/repo2', 'Org3/repo3', 'Org1/repo8') ORDER BY us DESC, event_key LIMIT 100"),
}
