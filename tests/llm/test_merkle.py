"""The manifest against a plain recursive one, with strides and digits small enough to need several of each."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle, radix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for every node its siblings, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            s = a - a % 3
            paths[i].append(("".join(level[s:a]), "".join(level[a + 1 : s + 3])))
            at[i] = a // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rows_ in groups.values():
        rows_.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([x for _, x in groups[g]]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (r, own), path in zip(groups[g], trees[g][1], strict=True):
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            now = leaf(r, r[1] if odd or r[1] is None else r[1].replace("\n", ""))
            for a, b in path + top:
                now = h(a, now, b)
            out.append((r[0], own, trees[g][0], root, h(*[a + b for a, b in path + top]), now, now == root))
    return sorted(out, key=str)


def rows(n, sources, seed=1):
    draw = random.Random(seed)
    ids = [draw.choice([i, i * 10**9, -i * 7, 2**63 - 1 - i]) for i in range(n - 10)] + [5] * 5 + [None] * 5
    out = [(i, draw.choice([None, "", "a\nb", "x", f"text {k}\n\n"]), draw.choice([None, "en"]), draw.choice(sources), draw.choice([None, 3])) for k, i in enumerate(ids)]
    return out + out[-3:]


@pytest.mark.parametrize(("n", "sources"), [(400, ["s", "s", "s", "é", None, "", "zz"]), (40, [f"s{i}" for i in range(30)]), (60, [None])])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, sources):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "ranked", lambda df, by, key: radix.ranked(df, by, key, digit=1, bucket_rows=4))
    data = rows(n, sources)
    docs = spark.createDataFrame(data, DOCS).select("*", F.lit("another").alias("TEXT"), F.lit(1).alias("path"), F.lit(1).alias("Digest"))
    assert sorted(map(tuple, merkle.proofs_of_documents(docs).collect()), key=str) == brute(data)


def test_one_row_one_group_and_none(spark):
    one = [(7, "a\nb", "en", "s", 3)]
    got = [tuple(r) for r in merkle.proofs_of_documents(spark.createDataFrame(one, DOCS)).collect()]
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3]
    assert merkle.proofs_of_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_any_change_is_found(spark):
    found = merkle.manifest(spark.createDataFrame(rows(100, ["a", "b"]), DOCS))
    other = found.withColumn("leaf", F.sha2("leaf", 256))
    assert found.filter(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert other.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).isEmpty()


def test_ranks(spark):
    draw = random.Random(3)
    keys = [f"{draw.choice([5, 5, 5, draw.getrandbits(40)]):016x}{i:04x}" for i in range(3000)]
    data = [(draw.choice("aaab"), k) for k in keys]
    df = spark.createDataFrame(data, "g string, k string")
    got = {(r["g"], r["k"]): (r["rank"], r["n"]) for r in radix.ranked(df, ["g"], "k", bucket_rows=50).collect()}
    want = {(g, k): (i, len(own)) for g in "ab" for own in [sorted(k for x, k in data if x == g)] for i, k in enumerate(own)}
    assert got == want and radix.ranked(df.filter("false"), ["g"], "k").count() == 0
    values = [0, -1, 1, 2**63 - 1, -(2**63), 255]
    ordered = spark.createDataFrame([(v,) for v in values], "v long").orderBy(radix.long_key(F.col("v"))).collect()
    assert [r[0] for r in ordered] == sorted(values)
