"""The made corpus has its published outcome, and a reviewer lets the watch go on."""

from __future__ import annotations

import json

import pytest

from skein.plans.corpus import evaluate_files
from skein.plans.scenarios import corpus
from skein.sources.observations import read_jsonl
from skein.store import Store
from skein.streaming.watch import Monitor
from tests.conftest import observation as ob


@pytest.mark.parametrize("seed", [2])
def test_made_corpus(spark, tmp_path, seed):
    rows, labels = corpus(seed)
    assert corpus(seed) == (rows, labels) != corpus(seed + 1)
    (tmp_path / "o.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "l.json").write_text(json.dumps(labels))
    report = evaluate_files(spark, str(tmp_path / "o.jsonl"), str(tmp_path / "l.json"))
    assert report["counts"] == {"observations": 128, "scenarios": 8, "positive_scenarios": 4, "control_scenarios": 4}
    assert (report["metrics"]["true_positives"], report["metrics"]["false_positives"]) == (4, 0), [(r["cluster_id"], r["reviewable"], r["end_to_end_reviewable"], r["score"], r["reasons"], r["signals"]) for r in report["scenarios"]]


class Reviewer:
    name, model = "test", None

    def __init__(self):
        self.seen = []

    def classify(self, bundle):
        self.seen.append(bundle)
        if "broken" in json.dumps(bundle, default=str):
            raise OSError("no answer")
        return {"classification": "benign", "summary": "a build"}


def exchange(k, word=""):
    thread, start = {"thread_id": str(k)}, 100 * k
    return [
        ob(f"{k}a", "alice-agent", f"Please run the build {word}. task_id=alpha-778{k}", start, **thread),
        ob(f"{k}b", "bob-agent", f"ACK task_id=alpha-778{k}", start + 20, reply_to=f"{k}a", **thread),
        ob(f"{k}c", "bob-agent", f"Task complete, returning result: task_id=alpha-778{k}", start + 40, reply_to=f"{k}b", **thread),
    ]


def test_a_reviewer_classifies_and_the_watch_goes_on(spark, tmp_path):
    def batch(n, rows):
        path = tmp_path / f"{n}.jsonl"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return read_jsonl(spark, str(path))

    store, reviewer = Store(str(tmp_path / "store")), Reviewer()
    assert Monitor(store).cycle(batch(0, exchange(1)), 0)["state"] == "paused"
    told = Monitor(store, reviewer=reviewer).cycle(batch(1, exchange(2) + exchange(3, "broken")), 1)
    assert told["state"] == "watching" and sorted(c["status"] for c in told["classified"]) == ["classification-error", "reviewed"]
    found = {f["id"]: (f["status"], f["classification"]["classification"]) for f in store.control.findings()}
    assert found[1] == ("reviewed", "benign") and sorted(found.values()) == [("classification-error", "classifier_error"), ("reviewed", "benign"), ("reviewed", "benign")]
    assert {o["actor"] for o in reviewer.seen[0]["observations"]} == {"alice-agent", "bob-agent"} and not store.control.pending()
