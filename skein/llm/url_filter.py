"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

A rule is a key ``host + path prefix``; it fits its host and all subdomains. The keys of the corpus are all pairs of a
host suffix and a path prefix that could be a rule's, for every URL. Over this complete universe a cascade answers
membership exactly: level 1 encodes the listed keys, level 2 those other keys that level 1 lets through, level 3 the
listed keys that level 2 lets through, and so on until a level lets nothing wrong through. Lookups test bits of constants
and need no join. Level 1 is sized so that it lets through about as many other keys as there are listed ones, so the
filters grow with the rules (and the logarithm of the universe), never with the pages.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. A URL that fits no rule gets the
default verdict. Of several rules that fit, the longest key wins, then the longest host. Repeated rows are judged one by
one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.names import chosen
from skein.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Listed keys that are sent to all executors to be taken out of the universe; more of them are joined.
BROADCAST_KEYS = 100_000

# The production rules (host, path prefix, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        array = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        tests = []
        for j in range(self.hashes):
            at = place(key, self.salt, j, self.bits)
            word = F.element_at(array, (F.shiftright(at, 6) + 1).cast("int"))
            tests.append(F.bit_get(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)


def place(key: Column, salt: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(bits).cast("long"))


def encode(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key``; only its words, whose number depends on count and rate, leave the executors."""
    bits = max(64, -(-math.ceil(-max(count, 1) * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*[place(F.col("key"), salt, j, bits) for j in range(hashes)])).alias("at")
    word = F.shiftright("at", 6).alias("word")
    set_ = keys.select(at).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    words = [0] * (bits // 64)
    for row in set_.collect():
        words[row["word"]] = row["bits"]
    return Level(salt, bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[depth - 1].holds(key), answer).otherwise(F.lit(depth % 2 == 0))
        return answer


def build(spark: SparkSession, listed: list[str], universe: DataFrame, most_levels: int = 40) -> Cascade:
    """``universe``: distinct keys in column ``key``, at rest, so that it can be read for every other level."""
    if not listed:
        return Cascade(())
    n_wanted = len(set(listed))
    wanted = spark.range(1).select(F.explode(F.lit(sorted(set(listed)))).alias("key"))
    others = universe.join(F.broadcast(wanted) if n_wanted <= BROADCAST_KEYS else wanted, "key", "left_anti")
    n_others = others.count()
    rate, salt = min(0.5, n_wanted / max(n_others, 1) / math.sqrt(2)), 0
    while True:
        first = encode(wanted, n_wanted, rate, salt)
        through = written(others.filter(first.holds(F.col("key"))), "through")
        n_through = through.count()
        if n_through <= 8 * n_wanted + 64:
            break
        rate, salt = rate / 8, salt + 1
    levels, inside, outside, n = [first], through, wanted, n_through
    while n:
        if len(levels) == most_levels:
            raise RuntimeError("the cascade did not end")
        level = encode(inside, n, 0.5, 1000 + len(levels))
        levels.append(level)
        inside, outside = outside.filter(level.holds(F.col("key"))), inside
        n = inside.count()
    return Cascade(tuple(levels))


def _candidates(rules: list[tuple[str, str, str]]) -> Column:
    """All (size, host size, key) of a row's ``host`` and ``path`` that could be a rule's."""
    out = []
    for labels in sorted({h.count(".") + 1 for h, _, _ in rules}):
        suffix = F.substring_index("host", ".", -labels)
        enough = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) >= labels - 1
        for size in sorted({len(p) for _, p, _ in rules}):
            key = F.concat(suffix, F.substring("path", 1, size))
            fits = enough & (F.col("host") != "") & (F.length("path") >= size)
            out.append(F.when(fits, F.struct(F.length(key).alias("n"), F.length(suffix).alias("h"), key.alias("key"))))
    return F.array_compact(F.array(*out))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    named = chosen(pages, id_col, url_col).select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = named.withColumn("_tried", _candidates(rules))
    universe = written(found.select(F.explode("_tried.key").alias("key")).distinct(), "universe")
    cascades = {v: build(pages.sparkSession, [h + p for h, p, x in rules if x == v], universe) for v in sorted({v for _, _, v in rules})}

    def verdict(tried: Column) -> Column:
        return F.coalesce(*[F.when(c.contains(tried["key"]), F.lit(v)) for v, c in cascades.items()])

    judged = F.transform("_tried", lambda t: F.struct(t["n"].alias("n"), t["h"].alias("h"), t["key"].alias("key"), verdict(t).alias("verdict")))
    best = F.array_max(F.filter(judged, lambda t: t["verdict"].isNotNull()))
    out = found.withColumn("_best", best)
    return out.select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH named AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
