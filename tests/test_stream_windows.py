"""Windows kept by state equal those of the whole history, batch by batch, late rows included."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from skein.operators.clustering import anchored_windows
from skein.operators.features import with_features
from skein.plans.analyze import analyze_members
from skein.sources.observations import read_jsonl
from skein.streaming import windows
from skein.streaming.watch import observation_stream
from tests.conftest import observation as ob

SAY = ["Please run it. task_id=alpha-{k}", "ACK task_id=alpha-{k}", "task complete, result task_id=alpha-{k}", "nothing new"]


def test_windows_follow_late_rows(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for i in range(150):
        at = draw.choice([draw.randrange(6 * 3600), 3600 * draw.randrange(6), 1800 * draw.randrange(12)])
        rows.append(ob(i, f"user{i % 4}", SAY[i % 4].format(k=i % 3), at, thread_id=str(i % 3)))
    folder, table = tmp_path / "in", windows.WindowTable(str(tmp_path / "table"))
    folder.mkdir()
    draw.shuffle(rows)
    seen, calls = [], []
    analysed = windows.analysed
    windows.analysed = lambda changes, *more: calls.append(changes.count()) or analysed(changes, *more)
    try:
        for n, part in enumerate((rows[:90], rows[90:146], rows[146:] + rows[:2])):
            (folder / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
            seen += part
            windows.start(observation_stream(spark, str(folder)), table, str(tmp_path / "checkpoint")).awaitTermination()
            whole = tmp_path / f"all{n}.jsonl"
            whole.write_text("".join(json.dumps(r) + "\n" for r in {r["source_event_id"]: r for r in seen}.values()))
            obs = read_jsonl(spark, str(whole)).withColumn("ingest_ord", F.unix_micros("event_time"))
            want = {(f"{r['key']}:{r['window']}", r["event_key"]) for r in anchored_windows(with_features(obs), "bucket").collect()}
            assert {tuple(r) for r in table.numbered(spark).collect()} == want, n
    finally:
        windows.analysed = analysed
    assert calls[2] < 100  # the third batch's windows, not the history
    feats = with_features(obs)
    members = table.members(spark).select(F.concat_ws("@", "bucket", "opener").alias("cluster_id"), "event_key")
    want = {(r["cluster_id"], round(r["score"], 9)) for r in analyze_members(feats, members).scores.collect()}
    assert {(r["cluster_id"], round(r["score"], 9)) for r in table.scores(spark).collect()} == want and max(s for _, s in want) > 0.5
