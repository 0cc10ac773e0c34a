"""Fetching payloads of public services: bounded, with retries left to the caller.

A collector that is given ``Web.get`` leaves the asking to executors (``service``), and no payload passes the driver. Any
other callable of that form, such as answers given in a test, is asked from the driver, one page after another. The payloads
become tables by the functions of ``feeds`` and ``archive``.
"""

from __future__ import annotations

import gzip
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.scratch import written
from skein.sources import archive, feeds

# The services' addresses, page sizes and the most items that a search gives.
API, SNIPPETS, FORUM, ARCHIVE = "https://api.github.com", "https://grep.app/api/search", "https://arctic-shift.photon-reddit.com/api", "https://data.gharchive.org"
PAGE, SNIPPET_PAGE, MOST, EVENT_PAGES = 100, 10, 1000, 10
FORUM_DAYS, FORUM_PLACES = 14, ("AI_Agents", "Autogpt", "LLMDevs")

Get = Callable[[str, dict], object]


class Refused(RuntimeError):
    """A service's refusal, with its status and the seconds that it asks to wait."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after

    @property
    def passing(self) -> bool:
        """Whether a later attempt may succeed."""
        return self.status in (403, 429) or 500 <= self.status < 600


class Web:
    """``address``: where all services are asked, in place of their own addresses."""

    def __init__(self, token: str | None = None, agent: str = "skein", timeout: float = 45.0, address: str | None = None):
        self.token, self.agent, self.timeout, self.address = token, agent, timeout, address

    @classmethod
    def from_environment(cls) -> Web:
        return cls(os.environ.get("GITHUB_TOKEN") or os.environ.get("GH_TOKEN"))

    def _open(self, url: str, accept: str):
        headers = {"User-Agent": self.agent, "Accept": accept}
        if self.token and url.startswith(API):
            headers["Authorization"] = f"Bearer {self.token}"
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            wait = e.headers.get("Retry-After", "")
            raise Refused(e.code, float(wait) if wait.isdigit() else None) from e

    def get(self, url: str, params: dict):
        with self._open(f"{url}?{urllib.parse.urlencode(params)}" if params else url, "application/json") as answer:
            return json.load(answer)

    def page(self, kind: str, query: str, number: int, size: int) -> list[dict]:
        """The items of one page of a search, or of the feed of public events."""
        if kind == "events":
            return self.get(f"{self.address or API}/events", {"per_page": size, "page": number})
        if kind == "snippets":
            return snippet_page(self.get(self.address and f"{self.address}/api/search" or SNIPPETS, {"q": query, "page": number}))
        return self.get(f"{self.address or API}/search/{kind}", {"q": query, "per_page": size, "page": number}).get("items", [])

    def comments(self, repository: str, kind: str, thread: int, number: int, size: int) -> list[dict]:
        return self.get(f"{self.address or API}/repos/{repository}/{kind}/{thread}/comments", {"per_page": size, "page": number})

    def save(self, url: str, path: Path, most_bytes: int) -> int:
        """Stores a file; more bytes than allowed are an error, and nothing is left behind."""
        partial = path.with_name(path.name + ".part")
        try:
            with self._open(url, "*/*") as answer, partial.open("wb") as out:
                n = copied(answer, out, most_bytes)
            partial.replace(path)
            return n
        finally:
            partial.unlink(missing_ok=True)


def copied(source, out, most_bytes: int) -> int:
    n = 0
    while chunk := source.read(1 << 16):
        n += len(chunk)
        if n > most_bytes:
            raise RuntimeError(f"the download exceeded its limit of {most_bytes} bytes")
        out.write(chunk)
    return n


def paged(fetch: Callable[[int, int], list], limit: int, start: int = 1, size: int = PAGE) -> tuple[list, bool]:
    """Up to ``limit`` items from page ``start`` on, and whether the pages ended before."""
    out: list = []
    number = max(1, start)
    while len(out) < limit:
        items = fetch(number, min(size, limit))
        if not items:
            return out, True
        out += items[: limit - len(out)]
        number += 1
    return out, False


def payloads(spark: SparkSession, items: list[dict], schema: str | StructType) -> DataFrame:
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "n long, raw string")
    return rows.orderBy("n").select(F.from_json("raw", schema).alias("p")).select("p.*")


class Source:
    """A search with its place; after ``collect``, ``exhausted`` says whether it has no further page."""

    exhausted = False
    #: What a search is called, and its page size.
    kind, size = "issues", PAGE

    def __init__(self, get: Get, query: str = "", limit: int = 100, start: int = 1):
        self.get, self.query, self.limit, self.start = get, query, max(1, min(limit, MOST)), start

    @property
    def web(self) -> Web | None:
        """The web that executors can ask in the driver's place."""
        owner = getattr(self.get, "__self__", None)
        return owner if type(owner) is Web else None

    def page(self, number: int, size: int) -> list[dict]:
        return self.get(f"{API}/search/{self.kind}", {"q": self.query, "per_page": size, "page": number}).get("items", [])

    def items(self, spark: SparkSession, schema: str) -> DataFrame:
        """The decoded items, and ``exhausted`` set: whether a page was empty."""
        if self.web is None:
            found, self.exhausted = paged(self.page, self.limit, self.start, self.size)
            return payloads(spark, found, schema)
        from skein.sources import service

        size = min(self.size, self.limit)
        pages = -(-self.limit // size)
        rows = written(service.search(spark, self.web, self.kind, self.query, max(1, self.start), pages, size), "pages")
        self.exhausted = rows.select("page").distinct().count() < pages
        own = (F.col("page") - max(1, self.start)) * size + F.col("place") < self.limit
        return service.decoded(rows.filter(own).orderBy("page", "place"), schema)


class Issues(Source):
    def collect(self, spark: SparkSession) -> DataFrame:
        return feeds.issue_observations(self.items(spark, feeds.ISSUE))


class Code(Source):
    kind = "code"

    def collect(self, spark: SparkSession) -> DataFrame:
        return feeds.code_observations(self.items(spark, feeds.CODE_HIT))


class Threads(Source):
    """Issues and pull requests with their conversations. ``allowed``: of a table of repositories, those that are to be read;
    all roots are held against it at once, before any conversation is asked for."""

    def __init__(self, get: Get, query: str, threads: int = 20, comments: int = 100, start: int = 1, allowed: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__(get, query, min(threads, PAGE), start)
        self.comments, self.allowed = max(1, min(comments, 500)), allowed

    def collect(self, spark: SparkSession) -> DataFrame:
        roots = self.items(spark, feeds.ROOT).withColumn("repository", F.nullif(F.regexp_extract(F.coalesce("repository_url", F.lit("")), "/repos/(.+)$", 1), F.lit(""))).filter("repository IS NOT NULL")
        if self.allowed:
            roots = roots.join(self.allowed(roots.select("repository").distinct()), "repository", "left_semi")
        roots = written(roots, "roots")
        asked = roots.select(F.col("id").alias("root_id"), "repository", "number", F.col("pull_request").isNotNull().alias("is_pull"))
        held = f"root_id long, {feeds.COMMENT}"
        if self.web is not None:
            from skein.sources import service

            said = written(service.comments(asked, self.web, self.comments), "comments")
            parts = [service.decoded(said.filter(F.col("kind") == kind), feeds.COMMENT, "root_id") for kind in ("issues", "pulls")]
        else:
            found: dict[str, list] = {"issues": [], "pulls": []}
            for root in asked.collect():
                for kind in ("issues", "pulls") if root["is_pull"] else ("issues",):
                    items, _ = paged(lambda n, size, kind=kind, root=root: self.get(f"{API}/repos/{root['repository']}/{kind}/{root['number']}/comments", {"per_page": size, "page": n}), self.comments)
                    found[kind] += [x | {"root_id": root["root_id"]} for x in items]
            parts = [payloads(spark, found[kind], held) for kind in ("issues", "pulls")]
        return feeds.thread_observations(roots.drop("repository"), *parts, self.comments)


class Events(Source):
    """The newest public events, of which a few pages are kept."""

    kind = "events"

    def __init__(self, get: Get, pages: int = 1):
        super().__init__(get, limit=max(1, min(pages, EVENT_PAGES)) * PAGE)

    def page(self, number: int, size: int) -> list[dict]:
        return self.get(f"{API}/events", {"per_page": size, "page": number}) if number <= self.limit // PAGE else []

    def collect(self, spark: SparkSession) -> DataFrame:
        return feeds.event_observations(self.items(spark, archive.EVENT))


class Snippets(Source):
    kind, size = "snippets", SNIPPET_PAGE

    def page(self, number: int, size: int) -> list[dict]:
        return snippet_page(self.get(SNIPPETS, {"q": self.query, "page": number}))

    def collect(self, spark: SparkSession) -> DataFrame:
        return feeds.snippet_observations(self.items(spark, feeds.HIT), self.query)


def snippet_page(answer: dict) -> list[dict]:
    return [{"repo": _raw(x.get("repo")), "path": _raw(x.get("path")), "snippet": _raw((x.get("content") or {}).get("snippet"))} for x in answer.get("hits", {}).get("hits", [])]


def _raw(value) -> str:
    if isinstance(value, dict):
        value = value.get("raw") or value.get("name")
    return str(value or "")


class Forum(Source):
    """Posts of the last days in each place, and the comments under those that fit the query."""

    def __init__(self, get: Get, query: str = "", limit: int = 25, comments: int = 30, places: tuple[str, ...] = FORUM_PLACES, now: datetime | None = None):
        super().__init__(get, query, limit)
        self.comments, self.places, self.now = comments, places, now

    def collect(self, spark: SparkSession) -> DataFrame:
        after = int(((self.now or datetime.now(UTC)) - timedelta(days=FORUM_DAYS)).timestamp())
        posts = [x for place in self.places for x in self.get(f"{FORUM}/posts/search", {"subreddit": place, "after": after, "limit": self.limit, "sort": "desc"}).get("data") or []]
        posts = [x for x in posts if float(x.get("created_utc") or 0) >= after]
        terms = feeds.query_terms(self.query)
        posts = [x for x in posts if not terms or any(t in f"{x.get('title') or ''}\n{x.get('selftext') or ''}".lower() for t in terms)]
        said = [x for post in posts for x in self.get(f"{FORUM}/comments/search", {"link_id": post["id"], "limit": self.comments}).get("data") or []]
        self.exhausted = True
        return feeds.forum_observations(payloads(spark, posts, feeds.POST), payloads(spark, said, feeds.POST_COMMENT), self.query)


def archive_file(hour: str, folder: str, web: Web | None = None, most_bytes: int = 512 << 20) -> tuple[str, dict[str, int]]:
    """The path of an archive hour and the size of its file; fetched if the folder does not hold it yet.

    A file over the byte limit, or a gzip stream without its end, is an error before anything is analysed.
    """
    path = Path(folder) / f"{archive.hour_name(hour)}.json.gz"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        (web or Web()).save(f"{ARCHIVE}/{path.name}", path, most_bytes)
    size = path.stat().st_size
    if size > most_bytes:
        raise RuntimeError(f"the archive exceeded its limit of {most_bytes} bytes")
    return str(path), {"compressed_bytes": size}


def whole_lines(path: str, most_event_bytes: int) -> None:
    """Reads a gzip file once: a stream without its end, or a line over the limit that no newline ends, is an error."""
    with gzip.open(path) as lines:
        try:
            last = b""
            while chunk := lines.readline(most_event_bytes + 2):
                last = chunk
                while not last.endswith(b"\n") and len(last) > most_event_bytes:
                    # The rest of a long line; only one that the file leaves open is an error.
                    rest = lines.readline(1 << 20)
                    if not rest:
                        raise RuntimeError("the archive ends within a line over the limit")
                    last = rest if rest.endswith(b"\n") else last
        except EOFError as e:
            raise RuntimeError("the gzip stream ended before its checksum") from e
