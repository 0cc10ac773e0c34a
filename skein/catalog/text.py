"""Text and URL functions over documents, pages and synthetic observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog.synthetic import observations, table, with_obs
from skein.functions import text as X


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived keys of raw rows."""
    from skein.sources.observations import RAW, derive_keys

    e = table(spark, sf_dir, "events")
    given = {
        "source": F.when(F.col("event_id") % 3 == 0, "gharchive").when(F.col("event_id") % 3 == 1, "GitHub-Events").otherwise("Forum"),
        "source_event_id": F.col("event_id").cast("string"),
        "actor": F.concat(F.lit("User"), "user_id"),
        "repository": F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("Acme/R"), F.col("user_id") % 7)),
        "thread_id": F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 50).cast("string")),
        "reply_to": F.when(F.col("event_id") % 2 == 0, (F.col("event_id") - 1).cast("string")),
    }
    raw = e.select("event_id", *[(given.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in RAW])
    return derive_keys(raw).select("event_id", "platform", "actor_key", "event_key", "resource_key", "conversation_key", "parent_key")


def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("normalized"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs named in pages, sorted and distinct, one row each."""
    urls = X.extract_urls(F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("html", F.lit(""))))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls).alias("place", "url"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = X.snippet_text(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(bare).alias("chars"), F.sha2(bare, 256).alias("digest"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", "source"), 256).alias("content_sha256"), F.length(F.substring("text", 1, 20000)).alias("kept_chars"), (F.length("text") > 20000).alias("truncated"))


def normalized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts that several sources hold."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", X.normalize_text(F.coalesce("text", F.lit(""))).alias("words"))
    g = d.groupBy("words").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))
    return g.filter("n >= 2 AND sources >= 2 AND words <> ''").select("first_doc", "n", "sources", F.sha2("words", 256).alias("digest"))


def opaque_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque payloads of observations with their entropy."""
    runs = observations(spark, sf_dir).select("event_key", F.explode(F.regexp_extract_all("text", F.lit(X.OPAQUE), F.lit(1))).alias("payload"))
    return runs.select("event_key", "payload", F.round(X.entropy(F.col("payload")), 6).alias("bits"), F.round(X.opaque_quality(F.col("payload")), 6).alias("quality"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.select("event_key", F.explode(X.artifacts(F.col("text"), F.col("artifact_urls"), F.col("code_blocks"), F.col("context_ids"))).alias("x")).select("event_key", "x.kind", "x.value")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("event_key", F.explode(X.references(X.clean_text(F.col("text")))).alias("ref"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(X.normalize_template(F.col("text")).alias("template")).agg(F.count("*").alias("n"))


def speech_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.select("event_key", F.explode(X.speech_acts(X.clean_text(F.col("text")))).alias("act"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(X.hash_sample(F.col("event_id").cast("string"), 0.05)).select("event_id")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("event_key", F.concat(F.lit("api_key="), "event_key", F.lit(" then "), "text").alias("t"))
    return o.select("event_key", X.redact(F.col("t")).alias("shown"))


QUERIES = {
    "keys": keys,
    "url_normalized": url_normalized,
    "page_urls": page_urls,
    "page_text": page_text,
    "content_hash": content_hash,
    "normalized_groups": normalized_groups,
    "opaque_runs": opaque_runs,
    "markers": markers,
    "references": references,
    "templates": templates,
    "speech_acts": speech_acts,
    "hash_sample": hash_sample,
    "redacted": redacted,
}
_KEYED = r"(?i)\b(?:task_id|task-id|job_id|worker_id|run_id|message_id|correlation_id|nonce|checkpoint|resume_token|continuation_token|state_id|lease_id)\b\s*[:=#]\s*[`\"]?[A-Za-z0-9][A-Za-z0-9._:/+=-]{5,127}"
_REFERENCE = r"(?i)\b(?:task(?:_id|-id| id)?|job_id|run_id|correlation_id|checkpoint|resume_token|continuation_token|state_id)\s*[:=#-]?\s*[`\"]?([A-Za-z0-9][A-Za-z0-9._-]{3,63})"
ORACLES = {
    "keys": """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'gharchive' WHEN 1 THEN 'GitHub-Events' ELSE 'Forum' END AS source, 'User' || user_id AS actor,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'acme/r' || (user_id % 7) END AS repo, CASE WHEN event_id % 5 <> 0 THEN event_id % 50 END AS thread FROM events),
      p AS (SELECT *, CASE WHEN source = 'Forum' THEN 'forum' ELSE 'github' END AS platform FROM r)
      SELECT event_id, platform, platform || ':actor:' || lower(actor) AS actor_key, platform || ':event:' || source || ':' || event_id AS event_key,
        platform || ':repository:' || repo AS resource_key, platform || ':repository:' || repo || ':thread:' || thread AS conversation_key,
        CASE WHEN event_id % 2 = 0 THEN platform || ':event:' || source || ':' || (event_id - 1) END AS parent_key FROM p""",
    "url_normalized": r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
        regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
      q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') AND lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content')), '&') AS kept FROM p)
      SELECT page_id, CASE WHEN scheme <> '' AND host <> '' AND host NOT IN ('github.com', 'www.github.com', 'docs.github.com')
        THEN scheme || '://' || host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS normalized FROM q""",
    "page_urls": r"""WITH u AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(coalesce(url, '') || ' ' || coalesce(html, ''), 'https?://[^\s<>''")\]]+'))) AS l FROM pages)
      SELECT page_id, CAST(i - 1 AS INTEGER) AS place, l[i] AS url FROM u, LATERAL unnest(range(1, len(l) + 1)) t(i)""",
    "page_text": r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS t FROM pages),
      c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
      d AS (SELECT page_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM c)
      SELECT page_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS digest FROM d""",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, source)) AS content_sha256, CAST(length(substring(text, 1, 20000)) AS INTEGER) AS kept_chars, length(text) > 20000 AS truncated FROM documents",
    "normalized_groups": """WITH d AS (SELECT doc_id, source, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+'), ' ') AS words FROM documents)
      SELECT min(doc_id) AS first_doc, count(*) AS n, count(DISTINCT source) AS sources, sha256(words) AS digest FROM d WHERE words <> '' GROUP BY words HAVING count(*) >= 2 AND count(DISTINCT source) >= 2""",
    "opaque_runs": with_obs(r"""WITH runs AS (SELECT event_key, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{28,}')) AS payload FROM obs),
      chars AS (SELECT event_key, payload, unnest(string_split(payload, '')) AS ch FROM runs),
      counts AS (SELECT event_key, payload, ch, count(*) AS k FROM chars GROUP BY ALL),
      e AS (SELECT event_key, payload, count(*) AS kinds, -sum(k / length(payload) * log2(k / length(payload))) AS bits FROM counts GROUP BY ALL)
      SELECT event_key, payload, round(bits, 6) AS bits, round(CASE WHEN kinds >= 14 THEN least(1.0, bits / 5.2) ELSE 0.0 END, 6) AS quality FROM e"""),
    "markers": with_obs(rf"""WITH hits AS (SELECT event_key, unnest(regexp_extract_all(text, '{_KEYED}')) AS m FROM obs),
      kv AS (SELECT event_key, lower(replace(regexp_extract(m, '^([A-Za-z_-]+)', 1), '-', '_')) AS k, lower(regexp_replace(regexp_extract(m, '[:=#]\s*(.*)$', 1), '[.,;)]+$', '')) AS v FROM hits)
      SELECT DISTINCT event_key, 'marker:' || k AS kind, v AS value FROM kv WHERE len(list_distinct(string_split(v, ''))) >= 4 AND NOT regexp_matches(v, '^[0-9]+$') AND v <> 'task-1234'
      UNION ALL SELECT event_key, 'external_url', replace(replace(url, '&utm_source=x', ''), '#top', '') FROM obs WHERE url IS NOT NULL"""),
    "references": with_obs(rf"""WITH hits AS (SELECT event_key, unnest(regexp_extract_all(text, '{_REFERENCE}', 1)) AS v FROM obs),
      c AS (SELECT event_key, regexp_replace(lower(v), '[.,;)]+$', '') AS ref FROM hits)
      SELECT DISTINCT event_key, ref FROM c WHERE ref NOT IN ('complete', 'completed', 'finished', 'accepted', 'result', 'the', 'this')"""),
    "templates": with_obs(r"""WITH t AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '<url>', 'g'), '\b[0-9a-f]{7,64}\b', '<hash>', 'g'), '\b\d+(?:\.\d+)*\b', '<number>', 'g') AS t FROM obs)
      SELECT substring(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 500) AS template, count(*) AS n FROM t GROUP BY 1"""),
    "speech_acts": with_obs(r"""SELECT event_key, 'delegation' AS act FROM obs WHERE regexp_matches(text, '(?i)\b(?:delegate|assign(?:ed)?|you handle|take (?:this|the) task|please (?:run|check|do))\b')
      UNION ALL SELECT event_key, 'ack' FROM obs WHERE regexp_matches(text, '(?i)\b(?:ack|acknowledged|accepted|claiming|received (?:the )?task|starting task)\b')
      UNION ALL SELECT event_key, 'result' FROM obs WHERE regexp_matches(text, '(?i)\b(?:task (?:is )?(?:complete|completed|finished)|returning (?:the )?result|report(?:ing)? back|result\s*[:=])')
      UNION ALL SELECT event_key, 'state_out' FROM obs WHERE regexp_matches(text, '(?i)\b(?:checkpoint (?:saved|created)|saved state|state transfer|continuation token)\b')
      UNION ALL SELECT event_key, 'state_in' FROM obs WHERE regexp_matches(text, '(?i)\b(?:resume from|resuming (?:from|with)|continue from|loaded checkpoint)\b')"""),
    "hash_sample": "SELECT event_id FROM events WHERE substring(sha256(CAST(event_id AS VARCHAR)), 1, 16) < '0ccccccccccccd00'",
    "redacted": with_obs(r"SELECT event_key, '[REDACTED] then ' || text AS shown FROM obs"),
}
