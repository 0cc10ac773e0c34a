"""The operators made of DataFrame functions alone: licences, mixing, sharding, URL rules."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import license_scan, mixing, sharding, url_filter
from skein.llm.license_texts import TEMPLATES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Licences


def dice_brute(text):
    def bigrams(t):
        w = re.sub("[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)).strip().split(" ")
        return set(zip(w, w[1:]))

    if text is None:
        return []
    lines = text.split("\n")
    out = []
    for line, unit in [(-1, text)] + (list(enumerate(lines)) if len(lines) > 1 else []):
        a = bigrams(unit)
        best = sorted((-2 * len(a & b) / (len(a) + len(b)), name) for name, b in ((n, bigrams(t)) for n, t in TEMPLATES.items()) if a)
        if best and -best[0][0] >= license_scan.LEAST:
            out.append((-best[0][0], line, best[0][1]))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def test_license_scan_equals_brute_force(spark):
    mit = TEMPLATES["mit"]
    texts = [None, "", "word", "no licence here at all", "x\nLicensed under CC BY-NC 4.0.\ny", "Released under the MIT License", mit, mit.upper().replace("\n", "  "), "Copyright\n" + mit.replace("Software", "Work", 1), mit[: len(mit) // 2], "intro\n" + TEMPLATES["isc"].replace("\n", " ") + "\nRELEASED UNDER THE MIT LICENSE.", " ".join(TEMPLATES["apache-2.0-header"].split()[:-3]), "é " * 4000]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(3, texts[3], "")], "doc_id long, text string, License_Matches string")
    out = license_scan.scan(df)
    no_python(out)
    got = {r["doc_id"]: [(m["dice"], m["line"], m["license"]) for m in r["license_matches"]] for r in out.collect()}
    for i, t in enumerate(texts):
        assert [(pytest.approx(d), n, x) for d, n, x in dice_brute(t)] == got[i], t
    rows = license_scan.licenses_of_documents(df).collect()
    assert len(rows) == len(texts) + 1 and license_scan.licenses_of_documents(df.filter("false")).count() == 0
    assert {r["doc_id"]: r["license"] for r in rows}[6] == "mit"


def test_licences_inside_longer_texts(spark):
    prose = "".join(f"some words of a long story about part {k} of chapter{k} and the rights{k} of the people{k} to use{k}\n" for k in range(40))
    mit, isc, gpl, apache = (TEMPLATES[x] for x in ("mit", "isc", "gpl-3.0-header", "apache-2.0-header"))
    hashed = "".join(f"# {x}\n" for x in gpl.split("\n"))
    texts = {
        1: (prose + mit + "\n" + prose, [(40, "mit")]),
        2: (hashed + prose, [(0, "gpl-3.0-header")]),
        3: (prose + isc.replace("AUTHOR", "COPYRIGHT HOLDER") + "\n\n" + prose + mit + "\n" + prose + mit, [(40, "isc"), (40 + 6 + 1 + 40, "mit"), (87 + mit.count("\n") + 1 + 40, "mit")]),
        4: (prose.replace("\n", " ") + "Released under the MIT License. " + prose.replace("\n", " "), [(0, "mit-notice")]),
        5: (prose + "intro words " + apache + "\n" + prose, [(40, "apache-2.0-header")]),
        6: (prose + mit[: len(mit) // 2] + prose, []),
        7: (prose * 5, []),
        8: (prose + "x y z Licensed under\nCC BY-SA 4.0. " + prose, [(40, "cc-by-sa-4.0-notice")]),
        9: (prose + "Released under the MIT License.\n" + prose, []),
    }
    out = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string"))
    no_python(out)
    got = {r["doc_id"]: r["license_matches"] for r in out.collect()}
    for i, (text, want) in texts.items():
        by_unit = [(line, name) for _, line, name in dice_brute(text)]
        assert sorted((m["line"], m["license"]) for m in got[i]) == sorted(want + by_unit), (i, got[i])
    assert got[1][0]["dice"] == got[2][0]["dice"] == got[4][0]["dice"] == 1.0


# Mixing


def labelled(n=300, seed=1):
    rng = random.Random(seed)
    lexicon = [[f"good{k}" for k in range(30)], [f"junk{k}$" for k in range(30)], [f"bad{k}" for k in range(30)]]
    shared = [f"the{k}" for k in range(10)]
    docs, labels = [], []
    for i in range(n):
        kind = 0 if i % 10 < 7 else 1 if i % 10 < 9 else 2
        docs.append((i, " ".join(rng.choice(shared + lexicon[kind]) for _ in range(rng.randrange(1, 80)))))
        if i % 2 == 0 or i % 10 == 9:
            labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


def test_targets_are_met(spark):
    docs, labels = labelled()
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    no_python(out)
    rows = out.toPandas()
    p = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows["rate"] >= 0).all()
    total = rows["tokens"].sum()
    reached = (rows["tokens"].to_numpy()[:, None] * rows["rate"].to_numpy()[:, None] * p).sum(axis=0) / total
    assert np.allclose(reached, [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=1e-5)
    truth = np.array([0 if i % 10 < 7 else 1 if i % 10 < 9 else 2 for i in rows["doc_id"]])
    assert (p.argmax(axis=1) == truth).mean() > 0.9
    assert rows["targets_met"].all() and (rows["target_gap"] < 1e-4).all()


def test_targets_out_of_reach_are_said(spark):
    """One kind of text alone cannot have three shares."""
    docs = spark.createDataFrame([(i, "good1 good2 good3") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, {"good": 0.1, "low": 0.1, "toxic": 0.8}).collect()
    assert not rows[0]["targets_met"] and rows[0]["target_gap"] > 0.1


def test_rates_equal_a_plain_projected_gradient(spark):
    """The steps applied to all rows in numpy give the same rates, and a step is 0 where nothing is left to correct."""
    docs, labels = labelled(120, seed=3)
    scored = mixing.with_posteriors(spark.createDataFrame(docs, "doc_id long, text string"), mixing.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).cache()
    targets = {"good": 0.5, "low": 0.5, "toxic": 0.0}
    solution = mixing.solve(scored, targets)
    steps = solution.steps
    rows = scored.withColumn("rate", mixing.rate_after(steps)).toPandas()
    p, t = rows[["_p0", "_p1", "_p2"]].to_numpy(), rows["_tokens"].to_numpy()
    r = np.ones(len(rows))
    for s in steps:
        r = np.where((r <= 0) & (p @ s.residual > 0), 0, np.maximum(0, r - p @ s.along))
    assert np.allclose(r, rows["rate"])
    share = np.array([0.5, 0.5, 0.0])
    error = lambda r: (((t * r) @ p / t.sum() - share) ** 2).sum()
    slow = np.ones(len(rows))
    for _ in range(20000):
        slow = np.maximum(0, slow - 1.0 * (p @ ((t * slow) @ p / t.sum() - share)))
    assert error(r) <= error(slow) + 1e-6


def test_mixing_odd_rows(spark):
    docs = [(1, None, 9), (2, "", 9), (None, "good1 good2", 9), (3, "good1", 9), (3, "good1", 9), (4, "junk1$ " * 20_000, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _n int")
    labels = spark.createDataFrame([(3, None, None), (4, 0, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(df, labels).collect()
    assert len(rows) == 6 and all(0 <= r["rate"] < 1e6 for r in rows) and [r["tokens"] for r in rows if r["doc_id"] == 1] == [0]
    out = mixing.mixed(df, labels)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(df, labels.filter("false")).count() == 6
    assert mixing.mix(df.filter("false"), labels).count() == 0


# Sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 1), (2, 5), (3, 3), (4, 4)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    order = sharding.hilbert_order(dims, bits)
    assert sorted(order.tolist()) == list(range(1 << dims * bits))
    cell = np.argsort(order)
    axes = np.stack([(cell >> bits * (dims - 1 - i)) & ((1 << bits) - 1) for i in range(dims)])
    assert (np.abs(np.diff(axes, axis=1)).sum(axis=0) == 1).all()


def shard_rows(n=900, seed=2):
    rng = random.Random(seed)
    return [(i, "x" * rng.randrange(0, 300), rng.choice(["en", "de", "fr", None]), "src0" if rng.random() < 0.4 else f"src{rng.randrange(20)}", 1) for i in range(n)]


def test_shards_are_even_compact_and_gapless(spark):
    rows = shard_rows() + [(5, "same", "en", "src0", 1)] * 40 + [(None, None, None, None, None), (None, "é", "en", "src1", 2)]
    out = sharding.document_shards(spark.createDataFrame(rows, DOCS).repartition(3))
    no_python(out)
    got = out.collect()
    assert len(got) == len(rows)
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(counts) == list(range(40)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    order = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shards_prune_on_several_dimensions(spark, tmp_path):
    df = spark.createDataFrame(shard_rows(4000), DOCS).withColumn("size", F.length("text"))
    dims = ["source", "size", "doc_id"]
    cut = sharding.hilbert_shards(df.select("doc_id", "source", "size"), dims, ["doc_id"], 16)
    m = sharding.manifest(cut, dims).toPandas()
    for d, share in (("size", 300), ("doc_id", 4000)):
        assert ((m[f"max_{d}"] - m[f"min_{d}"]) / share).mean() < 0.75
    sharding.write_shards(df, cut, ["doc_id"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 16


def cells_of(rows, dims):
    """The code of each dimension, from the curve's index."""
    bits = 4
    cell = np.argsort(sharding.hilbert_order(len(dims), bits))
    at = np.array([r["hilbert"] for r in rows])
    return [(cell[at] >> bits * (len(dims) - 1 - i)) & 15 for i in range(len(dims))]


@pytest.mark.parametrize("kind", ["short", "long", "shared", "skewed", "outlier", "doubles"])
def test_codes_have_near_equal_mass(spark, kind):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    values = {
        "short": [word(4) for _ in range(1000)],
        "long": ["https://www.example.com/en/" + word(20) for _ in range(1000)],
        "shared": ["x" * (i % 40) + word(3) for i in range(1000)],
        "skewed": [("same prefix " if rng.random() < 0.9 else "") + word(9) for _ in range(1000)],
        "outlier": [*range(1000), 1 << 60],
        "doubles": [rng.expovariate(1) ** 9 for _ in range(1000)] + [float("nan"), float("inf")],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "a " + {str: "string", int: "long", float: "double"}[type(values[0])])
    (codes,) = cells_of(sharding.hilbert_shards(df, ["a"], ["a"]).collect(), ["a"])
    assert sorted(set(codes)) == list(range(16)) and np.bincount(codes).max() <= 90


def test_a_common_value_has_one_code_and_null_the_first(spark):
    values = [None] * 30 + ["b"] * 500 + [f"c{k}" for k in range(400)] + ["a"] * 3
    df = spark.createDataFrame([(v,) for v in values], "a string")
    out = sharding.hilbert_shards(df, ["a"], ["a"]).collect()
    (codes,) = cells_of(out, ["a"])
    by_value = {}
    for r, code in zip(out, codes, strict=True):
        by_value.setdefault(r["a"], set()).add(int(code))
    assert all(len(x) == 1 for x in by_value.values()) and by_value[None] == {0} and len(set(codes)) >= 6
    assert [min(by_value[v]) for v in sorted(x for x in by_value if x)] == sorted(min(by_value[v]) for v in by_value if v)


def test_places_equal_brute_force(spark):
    """Codes by counting sorted values, the curve's index of the cell, ranks by sorting, and shards by dividing them."""
    rows = [(i, t, g, s, n) for i, t, g, s, n in shard_rows(700, seed=4) if g] + [(2, "same", "en", "src0", 1)] * 3
    out = sharding.document_shards(spark.createDataFrame(rows, DOCS)).collect()
    n = len(rows)

    def quantile_cuts(values):
        ordered = sorted(values)
        return sorted({ordered[max(0, -(-k * n // 16) - 1)] for k in range(1, 16)} - {ordered[0]})

    size = lambda t: len((t or "").encode()) + 16
    weights, ids = [math.log2(size(r[1])) for r in rows], [r[0] for r in rows]
    cuts = [sharding._cuts(spark.createDataFrame(rows, DOCS), [c], 4)[c] for c in ("lang", "source")] + [quantile_cuts(weights), quantile_cuts(ids)]
    for cut, column in zip(cuts[:2], (2, 3), strict=True):  # strings: a value's rank is within a 256th, and itself, of its cut
        values = sorted(r[column] for r in rows)
        assert cut == sorted(set(cut)) and all(any(abs(values.index(c) - k * n / 16) <= n / 256 + values.count(c) + max(map(values.count, values)) for k in range(1, 16)) for c in cut)
    order = sharding.hilbert_order(4, 4)
    keyed = []
    for r, w in zip(rows, weights, strict=True):
        cell = 0
        for cut, v in zip(cuts, (r[2], r[3], w, r[0]), strict=True):
            cell = cell * 16 + sum(v >= c for c in cut)
        keyed.append((int(order[cell]), r[0], zlib.crc32((r[1] or "").encode())))
    keyed.sort()
    want = sorted((i, c, rank * 40 // n, rank - -(-(rank * 40 // n) * n // 40)) for rank, (_, i, c) in enumerate(keyed))
    assert sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in out) == want


@pytest.mark.parametrize("n", [0, 1, 39, 41])
def test_few_rows(spark, n):
    got = sharding.document_shards(spark.createDataFrame(shard_rows(n), DOCS)).collect()
    assert len(got) == n and len({r["shard"] for r in got}) == min(n, 40) and all(0 <= r["shard"] < 40 for r in got)


# URL rules


def judged(url, rules=url_filter.RULES):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "://a.com/en/1", "HTTPS://WWW.Example.COM/en/712?x#y", "http://example.com/en/6", "http://badexample.com/en/7", "http://a.b.c.example.net/de/81", "http://example.net/de/7", "http://net/de/", "http://xnet/de/", "http://org/es", "http://x.org/es/?q=://z.com/en/", "http://com:80/en/", "http://ü.com/en/7", "http://a.com/EN/", "http://.com/en/", "a\nb://q.com/en/\n"]


def test_url_rules_equal_brute_force(spark):
    hosts = [f"h{k}.{d}" for k in range(40) for d in ("example.com", "example.net", "com", "org", "net")]
    urls = URLS + [f"http://{h}/{lang}/{k}" for h in hosts for lang in ("en", "de", "es") for k in (6, 7, 8)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string").withColumn("rule", F.lit("own"))
    out = url_filter.judge(df)
    no_python(out)
    rows = out.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"]]), urls[r["page_id"]]
    assert url_filter.judge(df.filter("false")).count() == 0


def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch):
    keys = [f"k{i}" for i in range(4000)]
    listed = keys[::40]
    universe = spark.createDataFrame([(k,) for k in keys], "key string").cache()
    for rate in (0.5, None):
        if rate:  # a careless first level forces many more
            plain = url_filter.encode
            monkeypatch.setattr(url_filter, "encode", lambda df, n, r, salt, plain=plain: plain(df, n, max(r, 0.06), salt))
        cascade = url_filter.build(spark, listed, universe)
        got = {r["key"] for r in universe.filter(cascade.contains(F.col("key"))).collect()}
        assert got == set(listed)
        monkeypatch.undo()
    assert len(cascade.levels) >= 1 and sum(x.bits for x in cascade.levels) < 40 * len(listed)
    assert universe.filter(url_filter.build(spark, [], universe).contains(F.col("key"))).count() == 0
