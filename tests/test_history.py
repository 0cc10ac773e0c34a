"""Tables of listed files against plain dictionaries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.history import History

SCHEMA = "k string, v int, at timestamp"


def table(spark, rows):
    return spark.createDataFrame([(k, v, at) for k, v, at in rows], "k string, v int, s long").select("k", "v", F.timestamp_seconds("s").alias("at"))


def values(df):
    return sorted((r["k"], r["v"]) for r in df.select("k", "v").collect())


def test_last_rows_of_a_key_count_and_the_newest_are_found(spark, tmp_path):
    h, held, r = History(str(tmp_path / "h"), "k", "at"), {}, random.Random(3)
    assert h.rows(spark) is None and h.newest(spark, 3) is None and h.count() == 0 and h.span() == (None, None)
    for turn in range(5):
        new = {f"k{r.randrange(60):02d}": (turn * 100 + i, r.choice([None, *range(turn * 40, turn * 40 + 60)])) for i in range(25)}
        h.put(table(spark, [(k, *v) for k, v in new.items()]).coalesce(2))
        held |= new
        assert values(h.rows(spark)) == sorted((k, v) for k, (v, _) in held.items()) and h.count() == len(held)
        for n in (1, 7, 30, 500):
            order = sorted(held, key=lambda k: (held[k][1] is None, -(held[k][1] or 0), k))[:n]
            assert [x["k"] for x in h.newest(spark, n).collect()] == order
    h.compact(spark)
    assert len(h.listed()) == 1 and values(h.rows(spark)) == sorted((k, v) for k, (v, _) in held.items())
    assert h.vacuum(spark) == 0 and h.vacuum(spark, -1) > 0 and h.count() == h.rows(spark).count() == len(held)


def test_only_touched_files_are_written_again_and_only_files_with_new_rows_are_read(spark, tmp_path):
    h = History(str(tmp_path / "h"), "k", "at")
    for day in range(6):
        h.put(table(spark, [(f"d{day}-{i}", i, day * 86400 + i) for i in range(20)]).coalesce(1))
    before = set(h.listed())
    names, least = h.holding_newest(30)
    assert len(before) == 6 and len(names) == 2 and least == 4 * 86400 * 1_000_000
    assert sorted({x[0] for x in h.newest(spark, 30).select("k").collect()}) == sorted([f"d5-{i}" for i in range(20)] + [f"d4-{i}" for i in range(10, 20)])
    assert len(h.newest(spark, 30).inputFiles()) == 2
    h.put(table(spark, [("d1-3", 99, 0), ("d1-3x", 1, 0)]).coalesce(1))
    assert len(before - set(h.listed())) == 1 and h.count() == 121 and dict(values(h.rows(spark)))["d1-3"] == 99
    h.put(table(spark, [("d1-3", 99, 0), ("d1-3x", 1, 0)]).coalesce(1))  # once more leaves the same rows
    assert h.count() == 121


def test_groups_null_keys_new_columns_and_empty_changes(spark, tmp_path):
    h = History(str(tmp_path / "h"), "k")
    h.put(spark.createDataFrame([], SCHEMA))
    assert h.rows(spark) is None
    h.put(table(spark, [("a", 1, 0), ("a", 2, 0), ("b", 3, 0), (None, 4, 0)]))
    h.put(table(spark, [("a", 5, 0), (None, 6, 0)]).withColumn("more", F.lit("x")))
    assert sorted((r["k"] or "", r["v"], r["more"] or "") for r in h.rows(spark).collect()) == [("", 4, ""), ("", 6, "x"), ("a", 5, "x"), ("b", 3, "")]
    with pytest.raises(ValueError, match="v is int"):
        h.put(spark.createDataFrame([("c", "text")], "k string, v string"))
    assert h.count() == 4


def test_a_change_that_was_overtaken_is_made_again(spark, tmp_path):
    one, two = History(str(tmp_path / "h"), "k"), History(str(tmp_path / "h"), "k")
    one.put(table(spark, [("a", 1, 0), ("b", 1, 0)]))
    create, met = two.log(spark).files.create, []

    def overtaken(name, text):
        if not met:
            met.append(name)
            one.put(table(spark, [("b", 2, 0)]))
        return create(name, text)

    two.log().files.create = overtaken
    two.put(table(spark, [("a", 3, 0)]))
    assert met and values(one.rows(spark)) == values(two.rows(spark)) == [("a", 3), ("b", 2)]


def test_compacted_files_hold_few_rows_however_well_they_compress(spark, tmp_path, monkeypatch):
    from skein import history

    monkeypatch.setattr(history, "FILE_ROWS", 1000)
    h = History(str(tmp_path / "h"), "k", "at")
    for part in range(2):
        h.put(table(spark, [(f"k{i:05d}", 1, i) for i in range(part, 8000, 2)]))
    h.compact(spark)
    files = sorted(h.listed().values(), key=lambda s: s["oldest"])
    assert len(files) >= 7 and max(s["rows"] for s in files) <= 2000 and sum(s["rows"] for s in files) == 8000
    assert all(a["newest"] < b["oldest"] for a, b in zip(files, files[1:]))
