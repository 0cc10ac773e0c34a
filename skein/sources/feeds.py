"""Payloads of other public sources as raw observations: conversation threads, forum posts, code-search snippets.

Fetching is left to the caller (``Collector``); a payload table has one row for each item, in the service's own fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.sources import archive
from skein.sources.observations import METADATA, canonical

MAX_TEXT = 20_000
USER = "struct<login:string,type:string>"
#: What metadata holds of an item besides its own fields.
_STANDING = "author_association string"
ROOT = f"id long, number long, title string, body string, created_at string, repository_url string, html_url string, state string, user {USER}, pull_request struct<url:string>, labels array<struct<name:string>>, comments long, {_STANDING}"
ISSUE = f"{ROOT}, updated_at string"
COMMENT = f"id long, body string, created_at string, html_url string, user {USER}, performed_via_github_app struct<slug:string>, in_reply_to_id long, path string, {_STANDING}"
POST = "id string, subreddit string, author string, created_utc string, title string, selftext string, score long, num_comments long"
POST_COMMENT = "id string, subreddit string, author string, created_utc string, body string, link_id string, parent_id string, score long"
HIT = "repo string, path string, snippet string"
CODE_HIT = "sha string, path string, html_url string, score double, repository struct<full_name:string,owner:struct<login:string>>"


class Collector(Protocol):
    """A source: canonical observations for a query and page."""

    def collect(self, spark: SparkSession) -> DataFrame: ...


CollectorFactory = Callable[[str, int], Collector]


def _raw(df: DataFrame, **given: Column) -> DataFrame:
    """Raw observations from the given columns; the rest is null. ``metadata`` may hold any keys."""
    text = given["text"]
    meta = given.pop("metadata", {})
    # A key without a value is kept as null.
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in meta.items()]), {"ignoreNullFields": "false"}) if meta else F.lit("{}")
    struct = F.struct(*[meta.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA])
    absent = ["event_key", "platform", "actor_key", "repository", "resource_key", "thread_id", "conversation_key", "reply_to", "parent_key"]
    columns = {name: F.lit(None).cast("string") for name in absent}
    columns |= {"observed_at": F.current_timestamp(), "artifact_urls": X.extract_urls(text), "code_blocks": X.extract_code_blocks(text), "content_sha256": F.sha2(text, 256)} | given
    url, method = columns.pop("url"), columns.pop("method")
    provenance = F.struct(url.alias("url"), F.lit(method).alias("retrieval_method"), F.current_timestamp().alias("retrieved_at"))
    return df.select(*[c.alias(k) for k, c in columns.items()], struct.alias("metadata"), provenance.alias("provenance"), whole.alias("metadata_text"))


def issue_observations(items: DataFrame) -> DataFrame:
    """Issues and pull requests of a search, without their conversations."""
    text = F.array_join(F.filter(F.array("title", "body"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    when = F.coalesce(F.to_timestamp(F.nullif("updated_at", F.lit(""))), F.to_timestamp("created_at"), F.current_timestamp())
    kind = F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue")
    return canonical(
        _raw(
            items, source=F.lit("github-search"), source_event_id=F.concat(F.lit("issue:"), "id"), event_time=when, actor=F.coalesce("user.login", F.lit("unknown")), event_type=kind, text=text,
            repository=F.nullif(F.regexp_extract(F.coalesce("repository_url", F.lit("")), r"/repos/(.+)$", 1), F.lit("")), thread_id=F.col("number").cast("string"), url=F.coalesce("html_url", F.lit("")), method=F.lit("github-rest-search-issues"),
            metadata={"number": F.col("number"), "state": F.col("state"), "labels": F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>")), "comments": F.coalesce("comments", F.lit(0)), "actor_type": F.col("user.type"), "author_association": F.col("author_association")},
        )
    )


def code_observations(items: DataFrame) -> DataFrame:
    """Files of a code search; the repository's owner counts as the actor."""
    path, repo = F.coalesce("path", F.lit("")), F.col("repository.full_name")
    none = F.array().cast("array<string>")
    return canonical(
        _raw(
            items, source=F.lit("github-code-search"), source_event_id=F.concat(F.lit("code:"), F.coalesce("sha", F.lit("None")), F.lit(":"), path), event_time=F.current_timestamp(), actor=F.coalesce("repository.owner.login", F.lit("unknown")),
            event_type=F.lit("code_search_hit"), text=F.concat(F.coalesce(repo, F.lit("None")), F.lit(":"), path), repository=repo, artifact_urls=none, code_blocks=none, url=F.coalesce("html_url", F.lit("")), method=F.lit("github-rest-search-code"), metadata={"path": F.col("path"), "sha": F.col("sha"), "score": F.col("score")},
        )
    )


def event_observations(events: DataFrame) -> DataFrame:
    """Public events as the service gives them."""
    return canonical(archive.normalise(events.select(F.struct(*events.columns).alias("e")), "github-public-events"))


def thread_observations(roots: DataFrame, comments: DataFrame, review_comments: DataFrame, comments_per_thread: int = 100) -> DataFrame:
    """Issues or pull requests with their comments and, for pull requests, review comments with native replies.

    ``comments`` and ``review_comments`` carry root_id. Roots without a repository are dropped with all they hold.
    """
    repo = F.regexp_extract("repository_url", r"/repos/(.+)$", 1)
    roots = roots.withColumn("repository", repo).filter("repository <> ''")
    is_pull = F.col("pull_request").isNotNull()
    text = F.array_join(F.filter(F.array("title", "body"), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    login = F.coalesce(F.col("user.login"), F.lit("unknown"))
    first = _raw(
        roots, source=F.lit("github-thread-search"), source_event_id=F.concat(F.lit("issue:"), "id"), event_time=F.coalesce(F.to_timestamp("created_at"), F.current_timestamp()), actor=login,
        event_type=F.when(is_pull, "pull_request").otherwise("issue"), text=text, repository=F.col("repository"), thread_id=F.col("number").cast("string"), url=F.coalesce("html_url", F.lit("")), method="github-rest-thread-search",
        metadata={"number": F.col("number"), "state": F.col("state"), "root": F.lit(True), "actor_type": F.col("user.type"), "author_association": F.col("author_association")},
    )
    keys = roots.select(F.col("id").alias("root_id"), "repository", F.col("number").cast("string").alias("thread_id"), F.col("html_url").alias("root_url"), is_pull.alias("is_pull"))

    root = F.concat(F.lit("issue:"), "root_id")
    thread = F.col("thread_id").cast("long")

    def replies(rows: DataFrame, prefix: str, kind: str, method: str, reply: Column, more: dict[str, Column]) -> DataFrame:
        from pyspark.sql import Window

        held = rows.join(keys, "root_id").withColumn("_n", F.row_number().over(Window.partitionBy("root_id").orderBy("created_at", "id"))).filter(F.col("_n") <= comments_per_thread)
        return _raw(
            held, source=F.lit("github-thread-search"), source_event_id=F.concat(F.lit(f"{prefix}:"), "id"), event_time=F.coalesce(F.to_timestamp("created_at"), F.current_timestamp()), actor=login, event_type=F.lit(kind),
            text=F.coalesce("body", F.lit("")), repository=F.col("repository"), thread_id=F.col("thread_id"), reply_to=reply, url=F.coalesce("html_url", "root_url", F.lit("")), method=method,
            metadata=more | {"conversation_root": root, "actor_type": F.col("user.type"), "author_association": F.col("author_association"), "github_app_slug": F.col("performed_via_github_app.slug")},
        )

    plain = replies(comments, "comment", "issue_comment", "github-rest-thread-comments", F.lit(None).cast("string"), {"issue_number": thread, "root": F.lit(False)})
    pulls = review_comments.join(keys.filter("is_pull").select("root_id"), "root_id", "left_semi")
    review = replies(pulls, "review-comment", "pull_request_review_comment", "github-rest-pr-review-comments", F.concat(F.lit("review-comment:"), "in_reply_to_id"), {"pull_request_number": thread, "path": F.col("path")})
    return canonical(first.unionByName(plain).unionByName(review))


def query_terms(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Za-z][A-Za-z_-]{2,}", query) if t.lower() not in ("and", "or", "not")]


def forum_observations(posts: DataFrame, comments: DataFrame, query: str = "") -> DataFrame:
    """Posts in which any term of the query occurs, and the comments that stand under them and still have a body."""
    terms = query_terms(query)
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("selftext", F.lit(""))))
    if terms:
        posts = posts.filter(F.exists(F.lit(terms), lambda t: F.contains(hay, t)))
    when = F.timestamp_seconds(F.col("created_utc").cast("double"))
    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("selftext", F.lit("")))
    text = F.when((title != "") & (body != ""), F.concat(title, F.lit("\n\n"), body)).otherwise(F.concat(title, body))
    sub, author = F.coalesce("subreddit", F.lit("unknown")), F.coalesce("author", F.lit("[deleted]"))
    place = F.concat(F.lit("https://www.reddit.com/r/"), sub, F.lit("/comments/"))
    none = F.array().cast("array<string>")
    first = _raw(
        posts, source=F.lit("reddit"), source_event_id=F.col("id"), observed_at=when, event_time=when, actor=author, platform=F.lit("reddit"), event_type=F.lit("submission"), text=F.nullif(F.substring(text, 1, MAX_TEXT), F.lit("")),
        repository=F.concat(F.lit("reddit/r/"), sub), thread_id=F.col("id"), url=F.concat(place, "id", F.lit("/")), method="arctic-shift", metadata={"subreddit": sub, "score": F.col("score"), "num_comments": F.col("num_comments")}, artifact_urls=none, code_blocks=none, content_sha256=F.lit(None).cast("string"),
    )
    link = F.regexp_replace(F.coalesce("link_id", F.lit("")), "^t3_", "")
    under = comments.filter(F.col("body").isNotNull() & ~F.col("body").isin("[deleted]", "[removed]")).withColumn("post_id", link).join(posts.select(F.col("id").alias("post_id")).distinct(), "post_id", "left_semi")
    parent = F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce("parent_id", F.lit("")), "^t1_", ""), "^t3_", ""), F.lit(""))
    said = _raw(
        under, source=F.lit("reddit"), source_event_id=F.col("id"), observed_at=when, event_time=when, actor=author, platform=F.lit("reddit"), event_type=F.lit("comment"), text=F.substring("body", 1, MAX_TEXT),
        repository=F.concat(F.lit("reddit/r/"), sub), thread_id=F.col("post_id"), reply_to=parent, url=F.concat(place, "post_id", F.lit("/comment/"), "id", F.lit("/")), method="arctic-shift", metadata={"score": F.col("score")}, artifact_urls=none, code_blocks=none, content_sha256=F.lit(None).cast("string"),
    )
    return canonical(first.unionByName(said))


def snippet_observations(hits: DataFrame, query: str = "") -> DataFrame:
    """Code-search hits: the snippet's text is the one code block, and the repository's owner counts as the actor."""
    content = X.strip(X.unescape(F.regexp_replace(F.coalesce("snippet", F.lit("")), "<[^>]+>", "")))
    repo, path = F.coalesce("repo", F.lit("")), F.coalesce("path", F.lit(""))
    text = F.trim(F.concat(repo, F.lit(":"), path, F.lit("\n"), content))
    url = F.when((repo != "") & (path != ""), F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/HEAD/"), path)).otherwise(F.lit("https://grep.app"))
    return canonical(
        _raw(
            hits, source=F.lit("grep.app"), source_event_id=F.concat(F.lit("grep:"), F.sha2(text, 256)), event_time=F.current_timestamp(), actor=F.coalesce(F.nullif(F.substring_index(repo, "/", 1), F.lit("")), F.lit("unknown")), platform=F.lit("github"),
            event_type=F.lit("code_search_hit"), text=text, repository=F.nullif(repo, F.lit("")), artifact_urls=F.array().cast("array<string>"), code_blocks=F.when(content != "", F.array(content)).otherwise(F.array().cast("array<string>")), url=url, method="grep.app-public-search", metadata={"path": path, "query": F.lit(query), "experimental": F.lit(True)},
        )
    )


def read_queries(path: str) -> list[str]:
    """Distinct queries of a YAML file ``families: {name: [query, ...]}``, in order; anything else is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f)
    families = given.get("families") if isinstance(given, dict) else None
    if not isinstance(families, dict):
        raise ValueError("a query file needs a mapping 'families'")
    out: list[str] = []
    for name, queries in families.items():
        if not isinstance(queries, list) or not all(isinstance(q, str) for q in queries):
            raise ValueError(f"queries of {name} must be a list of strings")
        out += [q.strip() for q in queries if q.strip()]
    return list(dict.fromkeys(out))
