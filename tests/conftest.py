from __future__ import annotations

import json
import os
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2026, 1, 5, 12, 0, tzinfo=UTC)


def observation(i: int, actor: str, text: str | None = None, at: float = 0.0, **more) -> dict:
    """One raw observation; ``at`` in seconds after START."""
    when = (START + timedelta(seconds=at)).isoformat()
    row = {
        "source": "jsonl",
        "source_event_id": str(i),
        "observed_at": when,
        "event_time": when,
        "actor": actor,
        "event_type": "IssueCommentEvent",
        "text": text,
        "repository": "acme/widgets",
        "thread_id": "7",
        "provenance": {"url": f"https://example.test/{i}"},
    }
    return row | more


@pytest.fixture(scope="session")
def observations(spark, tmp_path_factory):
    """Writes raw rows as JSON lines and reads them back as canonical observations."""
    from skein.sources.observations import read_jsonl

    def make(rows: list[dict]):
        path = tmp_path_factory.mktemp("obs") / "rows.jsonl"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return read_jsonl(spark, str(path))

    return make
