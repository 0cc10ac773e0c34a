"""Decontamination against a search for every window at every place."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from skein.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows: dict = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    df = spark.createDataFrame(docs, DOCS).select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("words"), F.lit(1).alias("row_id"))
    out = decontaminate.contaminated_documents(df, spark.createDataFrame(items, ITEMS).select("*", F.lit(1).alias("Item_Id")))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    return sorted(map(tuple, out.collect()), key=str)


def test_contamination_equals_brute_force(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "the", "the", "x1"]
    item = [" ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 4, 5, 9, 10, 11, 30]))) for _ in range(25)]
    items = list(enumerate(item)) + [(30, item[-1] + " tail"), (31, item[-1]), (7, "repeated id of seven words in all"), (None, "w1"), (40, None), (41, "..."), (42, "the the the the the the the the the the the the"), (43, "ÉTÉ w3")]
    docs = []
    for i in range(60):
        parts = draw.choices(vocabulary, k=draw.choice([0, 5, 50, 300]))
        for _ in range(draw.choice([0, 0, 1, 3])):
            own = words(draw.choice(item))
            a = draw.randrange(len(own))
            parts[draw.randrange(len(parts) + 1) : 0] = own[a : a + draw.choice([4, 9, 10, 12, 40])]
        docs.append((i, draw.choice([" ", ", ", "\n"]).join(parts).upper() if i % 9 == 0 else "--".join(parts)))
    docs += [(70, item[-1]), (71, "THE " * 500), (72, None), (73, ""), (74, " ".join(["the"] * 12)), (5, item[3]), (5, item[3]), (None, item[-2]), (75, f"{item[-1]} {item[-1]}"), (76, "\x00the\x7fthe the" * 40)]
    assert run(spark, docs, items) == brute(docs, items)


def test_without_items_or_documents(spark):
    docs = [(1, "some words"), (2, None)]
    assert run(spark, docs, []) == run(spark, docs, [(1, None)]) == brute(docs, [])
    assert run(spark, [], [(1, "some words")]) == []


def test_spans_and_bit_tables_of_any_size(spark, monkeypatch):
    """With a full bit table everything passes it, and the same is found."""
    docs = [(i, "a b c d e f g h i j k l " * (i % 3) + f"z{i}") for i in range(12)]
    items = [(1, "c d e f g h i j k l a"), (2, "l z4"), (3, "q " * 12)]
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    assert run(spark, docs, items) == brute(docs, items)
    _, spans, held = decontaminate.occurrences(spark.createDataFrame([(0, "x c d e f g h i j k l")], DOCS), spark.createDataFrame(items, ITEMS))
    assert [(r["start"], r["length"]) for r in spans.collect()] == [(1, 10)] and held.select("item_id").distinct().count() == 3
