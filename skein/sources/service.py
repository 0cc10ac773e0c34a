"""Public services as Spark sources: searches as batches of pages, comments of threads, and the feed of public events as a stream.

Executors ask for the pages, one partition a page, so that no payload passes the driver. A row is an item's JSON with its
place; the functions of ``feeds`` and ``archive`` make observations of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, Not

from skein.sources import fetch

SCHEMA = "page int, place int, repository string, raw string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Repositories that a search is narrowed to, or from, at most; the service bounds a query's length.
MOST_NAMED = 20


def _repository(item: dict) -> str | None:
    """The repository of an item of any service."""
    _, found, name = str(item.get("repository_url") or "").partition("/repos/")
    if found:
        return name
    held = item.get("repository") or item.get("repo")
    return (held.get("full_name") or held.get("name") or held.get("raw")) if isinstance(held, dict) else held


@dataclass
class PagePartition(InputPartition):
    page: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.query = options.get("kind", "issues"), options.get("query", "")
        self.start, self.pages, self.size = (int(options.get(k, d)) for k, d in (("page", 1), ("pages", 1), ("size", fetch.PAGE)))
        self.web = fetch.Web(options.get("token"), address=options.get("address"))
        self.named: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Named repositories become part of the question, so that no other is asked for; Spark still compares their case."""
        for f in filters:
            inner, sign = (f.child, "-") if isinstance(f, Not) else (f, "")
            if self.kind in ("issues", "code") and isinstance(inner, EqualTo | In) and inner.attribute == ("repository",):
                names = [inner.value] if isinstance(inner, EqualTo) else list(inner.value)
                if len(self.named) + len(names) <= MOST_NAMED and all(names):
                    self.named += [f"{sign}repo:{name}" for name in names]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(self.start + i) for i in range(self.pages)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        for i, item in enumerate(self.web.page(self.kind, " ".join([self.query, *self.named]).strip(), partition.page, self.size)):
            yield partition.page, i, _repository(item), json.dumps(item)


@dataclass
class EventRange(InputPartition):
    after: int
    to: int


class EventFeedReader(DataSourceStreamReader):
    """Offsets are event numbers, which the service hands out in ascending order. A batch is the events after one offset up to
    another, so that a batch run again after a restart holds the same events. The feed keeps few events; if it no longer
    reaches back to the batch's start the batch fails, or, with ``gaps=skip``, goes on with what is left."""

    def __init__(self, options: dict):
        self.pages, self.size = int(options.get("pages", fetch.EVENT_PAGES)), int(options.get("size", fetch.PAGE))
        self.skip_gaps, self.from_ = options.get("gaps", "fail") == "skip", options.get("from")
        self.web = fetch.Web(options.get("token"), address=options.get("address"))

    def _newest(self) -> int:
        return max((int(x["id"]) for x in self.web.page("events", "", 1, 1)), default=0)

    def initialOffset(self) -> dict:
        """The given number, else what the feed holds now is the first batch."""
        return {"id": int(self.from_) if self.from_ else 0}

    def latestOffset(self) -> dict:
        return {"id": self._newest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [EventRange(start["id"], end["id"])] if start["id"] < end["id"] else []

    def read(self, partition: EventRange) -> Iterator[tuple]:
        # Newest first: what is published meanwhile moves events to later pages, where they are met again, never missed.
        seen: set[int] = set()
        reached = partition.after == 0
        for page in range(1, self.pages + 1):
            items = self.web.page("events", "", page, self.size)
            for i, item in enumerate(items):
                number = int(item["id"])
                reached = reached or number <= partition.after
                if partition.after < number <= partition.to and number not in seen:
                    seen.add(number)
                    yield page, i, _repository(item), json.dumps(item)
            if reached and items and int(items[-1]["id"]) <= partition.after or not items:
                break
        if not reached and not self.skip_gaps:
            raise RuntimeError(f"the feed no longer holds the events after {partition.after}")

    def commit(self, end: dict) -> None:
        """The feed keeps no state of its readers."""


class Search(DataSource):
    """``spark.read.format("skein-search")``: pages of a search (issues, code, snippets) or of the feed of public events."""

    @classmethod
    def name(cls) -> str:
        return "skein-search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class EventFeed(DataSource):
    """``spark.readStream.format("skein-events")``: the feed of public events."""

    @classmethod
    def name(cls) -> str:
        return "skein-events"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventFeedReader(self.options)


def _options(web: fetch.Web, **more) -> dict[str, str]:
    given = {"address": web.address, "token": web.token, **more}
    return {k: str(v) for k, v in given.items() if v is not None}


def search(spark: SparkSession, web: fetch.Web, kind: str, query: str = "", page: int = 1, pages: int = 1, size: int = fetch.PAGE) -> DataFrame:
    """(page, place, repository, raw) of the items; filters on ``repository`` narrow the question itself."""
    spark.dataSource.register(Search)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(Search.name()).options(**_options(web, kind=kind, query=query, page=page, pages=pages, size=size)).load()


def event_stream(spark: SparkSession, web: fetch.Web, **options) -> DataFrame:
    spark.dataSource.register(EventFeed)
    return spark.readStream.format(EventFeed.name()).options(**_options(web, **options)).load()


def _said(batches: Iterator[pa.RecordBatch], web: fetch.Web, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for root in batch.to_pylist():
            for kind in ("issues", *(["pulls"] if root["is_pull"] else [])):
                items, _ = fetch.paged(lambda n, size, kind=kind, root=root: web.comments(root["repository"], kind, root["number"], n, size), most)
                if items:
                    yield pa.RecordBatch.from_pydict({"root_id": [root["root_id"]] * len(items), "kind": [kind] * len(items), "raw": [json.dumps(x) for x in items]}, pa.schema([("root_id", pa.int64()), ("kind", pa.string()), ("raw", pa.string())]))


def comments(roots: DataFrame, web: fetch.Web, most: int, tasks: int = 32) -> DataFrame:
    """(root_id, kind, raw) of the comments, and for pull requests the review comments, of ``roots`` (root_id, repository,
    number, is_pull). Other threads than these are not asked for."""
    asked = roots.select("root_id", "repository", "number", "is_pull").repartition(tasks, "root_id")
    return asked.mapInArrow(partial(_said, web=web, most=most), "root_id long, kind string, raw string")


def decoded(items: DataFrame, schema: str, *more: str) -> DataFrame:
    """The payloads by their fields, with further columns of ``items``."""
    return items.select(*more, F.from_json("raw", schema).alias("p")).select(*more, "p.*")
