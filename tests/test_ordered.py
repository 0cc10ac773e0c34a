"""Looking back in parts equals plain windows over whole groups."""

from __future__ import annotations

import random

import pytest

from skein.operators import clustering, ordered

HOUR = 3_600_000_000


def rows_of(seed, n=400):
    rng = random.Random(seed)
    groups = ["a", "b", None, "once"]
    return [(groups[0] if i % 3 else rng.choice(groups[:3]), rng.randrange(40) * HOUR // 2 + rng.choice([0, 0, 7]), i, f"k{i}") for i in range(n)] + [("once", 5, n, "last")]


def test_previous_and_counted(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(*r, int(r[2] % 4 == 0)) for r in rows], "g string, us long, o long, k string, flag int")
    by, order = ["g"], ["us", "o"]
    seen = {r["k"]: r["prev"] and r["prev"]["k"] for r in ordered.previous(df, by, order, ["k"]).collect()}
    counts = {r["k"]: r["flag"] for r in ordered.counted(df, by, order, "flag").collect()}
    assert len(seen) == len(counts) == len(rows)
    for g in {r[0] for r in rows}:
        before, n = None, 0
        for _, us, o, k in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            n += o % 4 == 0
            assert (seen[k], counts[k]) == (before, n)
            before = k


def never_silent(seed, n=600):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 1, HOUR // 9, HOUR // 3, HOUR - 1, HOUR])
        rows.append(("a", at, i, f"k{i}"))
    rng.shuffle(rows)
    return rows + [("b", 1, n, "b1"), ("b", HOUR + 1, n + 1, "b2"), ("b", HOUR + 2, n + 2, "b3"), ("b", HOUR + 2, n + 2, "b4"), ("b", 3 * HOUR, 7, "b5"), ("b", 3 * HOUR, 7, "b6"), (None, 3, n + 3, "n")]


@pytest.mark.parametrize(("rows", "few"), [(rows_of(5), 20_000), (rows_of(5), 2), (never_silent(1), 20_000), (never_silent(1), 0), (never_silent(2), 0)])
def test_windows_and_sessions_equal_a_walk(spark, monkeypatch, rows, few):
    monkeypatch.setattr(clustering, "SEGMENT_ROWS", few)
    df = spark.createDataFrame(rows, "g string, us long, ingest_ord long, event_key string")
    windows = {r["event_key"]: r["window"] for r in clustering.anchored_windows(df, "g", 60).collect()}
    sessions = {r["event_key"]: r["session"] for r in clustering.sessions(df, ["g"], 2).collect()}
    assert len(windows) == len(sessions) == len(rows)
    for g in {r[0] for r in rows}:
        start = last = None
        window = session = 0
        for _, us, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if start is None or us - start > HOUR:
                window += start is not None
                start = us
            session += last is not None and us - last > 2 * HOUR
            last = us
            assert (windows[k], sessions[k]) == (window, session)
