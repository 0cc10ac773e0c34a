"""A labelled corpus of eight made scenarios, 128 observations, from a seed: four coordinated, three human, one of benign
automation. Names and addresses are fictional. Labels are joined by source_event_id alone."""

from __future__ import annotations

import base64
import hashlib
import random
from datetime import UTC, datetime, timedelta

START = datetime(2026, 1, 5, 0, 0, tzinfo=UTC)


class _Scenario:
    def __init__(self, name: str, label: str, draw: random.Random):
        self.name, self.label, self.draw, self.rows = name, label, draw, []
        self.token = f"{name.lower()}-{draw.getrandbits(32):08x}-run"

    def say(self, actor: str, text: str, hours: float, place: str, thread: str, reply: int | None = None, kind: str = "IssueCommentEvent", **metadata) -> int:
        """Adds an observation and returns its place; ``reply`` is the place of the one replied to."""
        number = f"{self.name}-{len(self.rows):02d}"
        when = (START + timedelta(hours=hours, seconds=self.draw.randrange(5))).isoformat()
        row = {"source": "made", "source_event_id": number, "observed_at": when, "event_time": when, "actor": f"{self.name.lower()}-{actor}", "event_type": kind, "text": text, "repository": f"{self.name.lower()}/{place}", "thread_id": thread, "metadata": metadata, "provenance": {"url": f"https://corpus.invalid/{number}"}}
        if reply is not None:
            row["reply_to"] = self.rows[reply]["source_event_id"]
        self.rows.append(row)
        return len(self.rows) - 1


def _replies(s: _Scenario) -> None:
    """A task is given, taken and done by replies in one thread, four times."""
    for k in range(4):
        task = f"{s.token}{k}"
        first = s.say("lead", f"Please run the build. task_id={task}", k / 10, "core", "1")
        taken = s.say(f"hand{k % 2}", f"ACK task_id={task}", k / 10 + 0.01, "core", "1", first)
        s.say(f"hand{k % 2}", f"Task complete, returning result: task_id={task}", k / 10 + 0.03, "core", "1", taken)


def _across(s: _Scenario) -> None:
    """The same across two places, which only a shared reference joins."""
    for k in range(4):
        task = f"{s.token}{k}"
        s.say("planner", f"Please run the migration. task_id={task}", k / 10, "plans", "1")
        s.say("worker", f"ACK task_id={task}", k / 10 + 0.02, "jobs", "7")
        s.say("worker", f"Task complete, returning result: task_id={task}", k / 10 + 0.04, "jobs", "7")


def _opaque(s: _Scenario) -> None:
    """Encoded payloads that go to and fro every half minute."""
    for k in range(12):
        payload = base64.b64encode(hashlib.sha256(f"{s.token}{k}".encode()).digest() + b"xyz").decode()
        s.say(("north", "south")[k % 2], payload, k / 120, "relay", "3")


def _shifts(s: _Scenario) -> None:
    """Several accounts keep at it day and night with one credential, in two places."""
    credential = f"session-{hashlib.sha256(s.token.encode()).hexdigest()[:24]}"
    for k in range(32):
        s.say(f"shift{k % 3}", f"resuming work, step {k}. {credential}", 2.5 * k, f"site{k % 2}", f"{k // 8}")


def _humans(talk: list[str]):
    def scenario(s: _Scenario) -> None:
        for k in range(15):
            s.say(s.draw.choice(["ann", "bob", "cem", "dee"]), f"{talk[k % len(talk)]} ({k})", s.draw.uniform(0.3, 0.9) + k * 0.7, "talk", str(k // 5))

    return scenario


def _robots(s: _Scenario) -> None:
    for k in range(15):
        s.say(f"update[bot]{k % 2}", "Bump dependency left-pad; generated by automation", k, "deps", str(k), None, "PullRequestEvent", actor_type="Bot")


SCENARIOS = [
    ("P5", "pos", _replies),
    ("P6", "pos", _across),
    ("P7", "pos", _opaque),
    ("P8", "pos", _shifts),
    ("N1", "human", _humans(["Good morning, has anyone tried the new release?", "It works for me", "I will look at it after lunch", "thanks a lot"])),
    ("N2", "benign_automation", _robots),
    ("N3", "human", _humans(["The tests fail on my laptop", "which version do you use?", "the one from last week", "fixed by clearing the cache"])),
    ("N4", "human", _humans(["We should rename this option", "I would rather keep it", "could we vote on it", "no strong view here"])),
]


def corpus(seed: int = 2) -> tuple[list[dict], dict]:
    """Raw observations and their labels, as a file of labels has them."""
    rows, clusters = [], []
    for name, label, make in SCENARIOS:
        made = _Scenario(name, label, random.Random(f"{seed}:{name}"))
        make(made)
        rows += made.rows
        clusters.append({"id": name, "label": label, "scenario": make.__doc__ or name, "event_ids": [r["source_event_id"] for r in made.rows]})
    return rows, {"clusters": clusters}
