"""Text functions, with the negative cases that matter."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X


def value(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def none():
    return F.array().cast("array<string>")


def test_markers_outside_quotes_with_valid_values(spark):
    find = lambda t: X.artifacts(t, none(), none(), F.array(F.lit("deadbeef1")))
    got = value(
        spark, find, "task-id: Alpha-7781. and `nonce=\"abc123xyz\"", "> task_id=alpha-7781", "task_id=11111111", "task_id=aaaaaa1", "task_id=task-1234", "run_id=deadbeef1", "mytask_id=alpha-7781", "checkpoint#ck-12345;", "a bare 9f86d081884c7d659a2feaa0c55ad015 hash", None,
    )
    assert [[(x["kind"], x["value"]) for x in r] for r in got] == [[("marker:nonce", "abc123xyz"), ("marker:task_id", "alpha-7781")], [], [], [], [], [], [], [("marker:checkpoint", "ck-12345")], [], []]


def test_urls(spark):
    urls = ["http://Ex.ORG:80/A?b=1&utm_source=x&c=&d=%7E*+z#f", "https://github.com/a/b", "ftp://x.org/", "https://user@GITHUB.com/x", "HTTPS://x.org", "https://x.org/p?q", "not a url", "https://x.org/?a=%zz", None]
    assert value(spark, X.normalize_url, *urls) == ["http://ex.org:80/A?b=1&d=~%2A+z", None, None, None, "https://x.org", "https://x.org/p", None, "https://x.org/?a=%25zz", None]
    assert value(spark, X.extract_urls, "see http://b.c/d, (https://a.b/c) http://b.c/d", None) == [["http://b.c/d", "http://b.c/d,", "https://a.b/c"], []]


def test_code_blocks(spark):
    body = "\n".join(f"line {k} = value({k})  " for k in range(12))
    blocks = value(spark, X.extract_code_blocks, f"x ```python\n{body}\n``` y ```\n\n```", "no code")
    assert [len(b) for b in blocks] == [1, 0]
    same = value(spark, X.canonical_code, body, "\n" + body.replace("  \n", "\n"), "short", "a" * 200)
    assert same[0] == same[1] and same[0] and same[2:] == [None, None]


def test_clean_text_drops_markup_code_and_quotes(spark):
    assert value(spark, X.clean_text, "keep\n> quoted\n<details open>gone\n</details>also ```code``` end\r\n  > q", None) == ["keep\nalso  end", ""]


def test_negation_reaches_as_far_as_it_should(spark):
    act = lambda t: X.unnegated(t, X.ACTS["result"])
    got = value(
        spark, act, "returning the result", "do not say task complete", "not yet. task complete", "never mind all these many many words: task complete", "not aaaaaaaaaaaaaaaaaa returning the result: x", "not done: returning result here. Later: task complete", "",
    )

    def plain(t):
        pattern = re.compile(X.ACTS["result"].removeprefix("(?iU)"), re.I)
        guard = re.compile(X.NEGATION.removeprefix("(?iU)"), re.I)
        return any(not guard.search(t[max(0, m.start() - 32) : m.start()]) for m in pattern.finditer(t))

    texts = ["returning the result", "do not say task complete", "not yet. task complete", "never mind all these many many words: task complete", "not aaaaaaaaaaaaaaaaaa returning the result: x", "not done: returning result here. Later: task complete", ""]
    assert got == [plain(t) for t in texts] and got[:2] == [True, False]


def test_opaque_payloads_need_variety(spark):
    import base64

    good = base64.b64encode(bytes(range(7, 250, 8))).decode()
    assert value(spark, X.opaque_payloads, f"x {good} y", "a" * 40, good[:20], f"{good}!{good}") == [[good], [], [], [good, good]]
    bare = good.rstrip("=")
    n = Counter(bare)
    bits = -sum(k / len(bare) * math.log2(k / len(bare)) for k in n.values())
    assert value(spark, X.entropy, bare)[0] == pytest.approx(bits)


def test_protocol_classes(spark):
    got = value(spark, X.protocol_hits, "TASK-ID: job-1234 ACK retry_count=2 heartbeat", "nothing", None)
    assert got == [["task_identifier", "acknowledgement", "heartbeat", "ttl_sequence"], [], []]


def test_templates_redaction_snippets_and_bots(spark):
    assert value(spark, X.normalize_template, "Build 12.4 of 9f86d081 at  https://x.y/z\n OK") == ["build <number> of <hash> at <url> ok"]
    assert value(spark, X.commit_template, "Fix #12 in 9f86d081 v3") == ["fix #<var> in <var> v3"]
    assert value(spark, X.redact, "password: hunter2 and ghp_abcdefghijklmnopqrstuv and sk-abcdefghijklmnopqrstuv") == ["[REDACTED] and [REDACTED] and [REDACTED]"]
    assert value(spark, X.snippet_text, " <b>a</b> &lt;x&gt; &amp;amp; &quot;q&quot; ") == ['a <x> &amp; "q"']
    bots = value(spark, lambda t: X.bot_identity(t, F.lit(None).cast("string"), F.lit(None).cast("string")), "renovate-x", "abbot", "my-ci", "x[bot]", "robot", "bot-1")
    assert bots == [True, False, True, True, False, True]


def test_hash_sample_is_a_share(spark):
    rows = spark.range(4000).select(X.hash_sample(F.col("id").cast("string"), 0.25).alias("s")).filter("s").count()
    assert 850 < rows < 1150
    assert spark.range(10).filter(X.hash_sample(F.col("id").cast("string"), 0.0)).count() == 0 and spark.range(10).filter(X.hash_sample(F.col("id").cast("string"), 1.0)).count() == 10


def test_short_ways_change_no_result(spark, monkeypatch):
    """Texts without quotes or negations take a short way; forced along the long one they come out the same."""
    words = ["ack", "not", "knot ack", "do not ", "please run", "> ", "\n", "\r\n", "\r", "\x0b", " ", "noon", "Never", "don't", " ", ". ", "a > b", "resuming from", "x" * 30, "\n> ack"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 12))) for _ in range(1500)] + ["", None, "\n\n", "ack\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def results():
        return rows.select("i", X.strip_quoted_lines(F.col("t")).alias("s"), X.speech_acts(X.clean_text(F.col("t"))).alias("a")).orderBy("i").collect()

    short = results()
    monkeypatch.setattr(X, "QUOTE_OR_BREAK", "(?s)^")
    monkeypatch.setattr(X, "NEGATING", "(?s)^")
    assert short == results() and len({tuple(r["a"]) for r in short}) >= 4
