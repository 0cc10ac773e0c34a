"""The audit against filters that are run in every order."""

from __future__ import annotations

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from skein.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def failures(docs):
    first: dict = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i]
        out.append({x for x, failed in zip("ABCDE", tests, strict=True) if failed})
    return out


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails, out = failures(docs), []
    for part in {lang or "" for _, _, lang in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, fails, strict=True) if (lang or "") == part]
        shapley, rows = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [i for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                before = set(order[:k])
                rows.append([part, "".join(order), k + 1, len(left), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)])
                shapley[x] += len(gone)
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_equals_filters_in_every_order(spark):
    draw = random.Random(5)
    words = ["word%d" % i for i in range(300)] + ["LOUD", "é", "$5"]
    texts = [" ".join(draw.choices(words[: draw.choice([40, 300, 303])], k=draw.choice([3, 99, 100, 101, 400]))) for _ in range(60)]
    texts += [None, "", " \t\n", "A" * 200, "É " * 120, "\x0b".join(map(str, range(100))), "a b " * 200]
    docs = [(i, t, draw.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(100 + i, draw.choice(texts), draw.choice(["en", "de"])) for i in range(60)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (3, texts[3], "en"), (3, texts[3], "en"), (3, texts[4], "xx")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("mask"), F.lit(1).alias("good"))
    said = spark.createDataFrame(labels, LABELS).select("*", F.lit(1).alias("Quality"))
    assert sorted(map(tuple, filter_audit.audit(df, said).collect())) == brute(docs, labels)


def test_empty_tables(spark):
    none, said = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, said).count() == 0
    docs = [(1, "a b", "en")]
    assert sorted(map(tuple, filter_audit.audit(spark.createDataFrame(docs, DOCS), said).collect())) == brute(docs, [])


def test_edges(spark):
    assert filter_audit.steps(spark).count() == 600 and filter_audit.steps(spark).select("applied", "filter").distinct().count() == 80
