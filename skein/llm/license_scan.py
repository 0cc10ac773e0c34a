"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams, with DataFrame functions.

The units of a document are its whole text and, if it has several, each of its lines. A unit is lower-cased, every run of
other characters than a-z and 0-9 becomes one space, and its distinct word bigrams are compared with each template's:
2 * common / (unit's + template's). A coefficient of at least t needs sizes within t / (2 - t) of each other, so only
templates within these bounds are tried, and only for units that share a bigram with any template at all.

Runs of words across or within lines are compared as well, so that a wrapped licence inside a longer file, or a notice
inside a long line, is found. A neighbour among the template's bigrams never lowers a run's coefficient and other bigrams
at its ends never raise it, so only runs that begin and end with stretches of the template's bigrams are tried, up to
(2 - t) / t of the template's length (or one stretch). Of a template's runs that overlap the best stays. A run is left out
where a match with more common bigrams, or a matched unit around or across it, holds so many of its template's bigrams
that the other template alone accounts for it.

Everything is a row's own expression: no shuffle, no join; the templates are constants whose size does not depend on the
data.

Cases: a null text, or one without two words in a unit, matches nothing. A run's line is that of its first word. Ties: the
higher coefficient, then the whole text before lines, then the first line, then the alphabetically first template.
Repeated rows get equal answers, and an empty table gives an empty result. Other columns are passed through; own columns
that bear the result's name (in any case) are kept with ``own_`` before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skein.llm.license_texts import TEMPLATES
from skein.llm.names import chosen, numbered, with_results
from skein.llm.url_filter import LOWER, UPPER

LEAST = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _keys(words: Column) -> Column:
    """64-bit keys of neighbouring words, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _bigrams(words: Column) -> Column:
    """Distinct 64-bit keys of neighbouring words."""
    return F.array_distinct(_keys(words))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _apart(runs: Column, clash: Callable[[Column, Column], Column]) -> Column:
    """Of sorted runs those that clash with none taken before."""
    return F.aggregate(runs, F.filter(runs, lambda r: F.lit(False)), lambda taken, r: F.when(F.exists(taken, lambda a: clash(a, r)), taken).otherwise(F.concat(taken, F.array(r))))


def _overlap(a: Column, b: Column) -> Column:
    return (a["at"] <= b["to"]) & (b["at"] <= a["to"])


def _first(a: Column, b: Column, *orders: tuple[str, int]) -> Column:
    """A comparator by fields: 1 ascending, -1 descending."""
    out = F.lit(0)
    for name, way in reversed(orders):
        out = F.when(a[name] != b[name], F.when(a[name] < b[name], -way).otherwise(way)).otherwise(out)
    return out


def _runs_of(t: Column, hits: Column, keys: Column, least: float) -> Column:
    """(at, to, dice, common, license) of the runs that match a template, apart from each other; at and to are bigrams."""
    share = least / (2 - least)
    most = F.ceil(t["length"] / share).cast("int")

    def paired(own: Column) -> Column:
        starts = F.filter(own, lambda h: F.coalesce(F.get(own, h["i"] - 1)["at"] != h["at"] - 1, F.lit(True)))
        ends = F.filter(own, lambda h: F.coalesce(F.get(own, h["i"] + 1)["at"] != h["at"] + 1, F.lit(True)))
        return _let(ends, lambda ends: F.flatten(F.transform(starts, lambda s, k: from_start(s, F.slice(ends, k + 1, F.least(F.size(ends) - k, most + 1))))))

    def from_start(s: Column, ends: Column) -> Column:
        tried = F.filter(ends, lambda e, k: (e["i"] - s["i"] + 1 >= t["n"] * share) & ((k == 0) | (e["at"] - s["at"] < most)))
        return F.transform(tried, lambda e: _let(F.array_distinct(F.slice(keys, s["at"] + 1, e["at"] - s["at"] + 1)), lambda b: measured(s, e, b)))

    def measured(s: Column, e: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(b, t["b"]))
        return F.struct(s["at"].alias("at"), e["at"].alias("to"), (2.0 * common / (F.size(b) + t["n"])).alias("dice"), common.alias("common"), t["license"].alias("license"))

    own = F.transform(F.filter(hits, lambda h: F.array_contains(t["b"], h["x"])), lambda h, i: F.struct(h["at"].alias("at"), i.alias("i")))
    good = F.filter(_let(own, paired), lambda r: r["dice"] >= least)
    best = F.array_sort(good, lambda a, b: _first(a, b, ("dice", -1), ("at", 1), ("to", -1)))
    return _let(best, lambda runs: _apart(runs, _overlap))


def _runs(text: Column, constants: Column, known: list[int], hides: Column, least: float, fewest: float) -> Column:
    """The runs of a text that match a template and that no larger run accounts for."""
    share = least / (2 - least)

    def found(keys: Column) -> Column:
        return _let(F.filter(keys, lambda x: x.isin(known)), lambda hit: F.when(F.size(F.array_distinct(hit)) >= fewest, of_hits(keys, hit)))

    def of_hits(keys: Column, hit: Column) -> Column:
        near = F.filter(constants, lambda t: F.size(F.array_intersect(hit, t["b"])) >= t["n"] * share)
        hits = F.filter(F.transform(keys, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda h: h["x"].isin(known))
        return F.when(F.size(near) > 0, _let(hits, lambda hits: F.flatten(F.transform(near, lambda t: _runs_of(t, hits, keys, least)))))

    words = F.split(normalised(text), " ")
    runs = _let(words, lambda words: F.when(F.size(words) - 1 >= fewest, _let(_keys(words), found)))
    larger = F.array_sort(runs, lambda a, b: _first(a, b, ("common", -1), ("dice", -1), ("at", 1), ("license", 1)))
    return _let(larger, lambda runs: _apart(runs, lambda a, r: _overlap(a, r) & F.array_contains(hides[a["license"]], r["license"])))


def _with_lines(runs: Column, text: Column) -> Column:
    """(dice, line, last, license) of runs: the lines of the first and the last word."""
    counts = F.transform(F.split(text, "\n"), lambda t: F.size(F.filter(F.split(normalised(t), " "), lambda w: w != "")))

    def line(counts: Column, word: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("line"))

        def step(a: Column, n: Column) -> Column:
            return F.struct((a["words"] + n).alias("words"), (a["line"] + F.when(a["words"] + n <= word, 1).otherwise(0)).alias("line"))

        return F.aggregate(counts, start, step, lambda a: a["line"])

    return _let(counts, lambda counts: F.transform(runs, lambda r: F.struct(r["dice"].alias("dice"), line(counts, r["at"]).alias("line"), line(counts, r["to"] + 1).alias("last"), r["license"].alias("license"))))


def _measured(spark: SparkSession, templates: dict[str, str]) -> list[Row]:
    """(license, n, b, length) of every template: its distinct bigrams and its length in bigrams."""
    if not templates:
        return []
    known = F.explode(F.create_map(*[F.lit(x) for pair in sorted(templates.items()) for x in pair])).alias("license", "text")
    words = F.split(normalised(F.col("text")), " ")
    return spark.range(1).select(known).withColumn("b", _bigrams(words)).select("license", F.size("b").alias("n"), "b", (F.size(words) - 1).alias("length")).orderBy("license").collect()


def scan(df: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``df`` with ``license_matches``: array of (dice, line, license), the best of each unit, and runs that no matched unit
    accounts for; line is -1 for the text."""
    plain, of = numbered(df)
    rows = _measured(df.sparkSession, templates)
    text = F.col(of(text_col))
    known_bigrams = sorted({b for r in rows for b in r["b"]})
    constants = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["n"]).alias("n"), F.lit(list(r["b"])).cast("array<bigint>").alias("b"), F.lit(r["length"]).alias("length")) for r in rows])
    share = least / (2 - least)
    # Templates so much of which stands in another that a match of the other accounts for theirs.
    within = {r["license"]: [s["license"] for s in rows if len(set(r["b"]) & set(s["b"])) >= share * s["n"]] for r in rows}
    hides = F.create_map(*[x for name, held in within.items() for x in (F.lit(name), F.array(*map(F.lit, held)))])
    lines = F.split(text, "\n")
    texts = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(F.array(text))
    units = F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t, i: F.struct((i - 1).alias("line"), F.split(normalised(t), " ").alias("words")))
    # Shorter units than the smallest template allows need no bigrams.
    fewest = min((r["n"] for r in rows), default=0) * share
    units = F.filter(units, lambda u: F.size(u["words"]) - 1 >= F.lit(fewest))
    sized = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["words"]).alias("b")))
    sized = F.transform(sized, lambda u: F.struct(u["line"].alias("line"), F.size(u["b"]).alias("n"), F.filter(u["b"], lambda x: x.isin(known_bigrams)).alias("b")))
    sized = F.filter(sized, lambda u: F.size(u["b"]) >= F.greatest(F.lit(1.0), least / 2 * u["n"]))

    def tried(u: Column) -> Column:
        near = F.filter(constants, lambda t: (t["n"] >= u["n"] * share) & (u["n"] >= t["n"] * share))
        dice = F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(u["b"], t["b"])) / (u["n"] + t["n"])).alias("dice"), u["line"].alias("line"), t["license"].alias("license")))
        return F.get(F.array_sort(F.filter(dice, lambda m: m["dice"] >= least), _better), 0)

    found = F.filter(F.transform(sized, tried), lambda m: m.isNotNull())
    if not rows:
        return _named(plain, df, found)

    def joined(found: Column, runs: Column) -> Column:
        across = lambda m, r: (m["line"] == -1) | m["line"].between(r["line"], r["last"])
        alone = F.filter(runs, lambda r: ~F.exists(found, lambda m: across(m, r) & F.array_contains(hides[m["license"]], r["license"])))
        return F.concat(found, F.transform(alone, lambda r: F.struct(r["dice"].alias("dice"), r["line"].alias("line"), r["license"].alias("license"))))

    def matches(found: Column) -> Column:
        runs = _runs(text, constants, known_bigrams, hides, least, fewest)
        return _let(runs, lambda runs: F.when(F.size(runs) > 0, _let(_with_lines(runs, text), lambda runs: joined(found, runs))).otherwise(found))

    return _named(plain, df, F.array_sort(_let(found, matches), _better))


def _named(plain: DataFrame, df: DataFrame, matches: Column) -> DataFrame:
    return with_results(plain.withColumn("matches_", matches).toDF(*df.columns, "matches_"), ["license_matches"], ["matches_"])


def _better(a: Column, b: Column) -> Column:
    return (
        F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1))
        .when(a["line"] != b["line"], F.when(a["line"] < b["line"], -1).otherwise(1))
        .when(a["license"] == b["license"], 0)
        .otherwise(F.when(a["license"] < b["license"], -1).otherwise(1))
    )


def licenses_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, license, dice, line (of the best match), n_matches, licenses (all, joined) of every row."""
    found = scan(chosen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    best = F.get("license_matches", 0)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"), best["line"].alias("line"), F.size("license_matches").alias("n_matches"), names.alias("licenses"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    clean = "trim(regexp_replace(translate({}, '" + UPPER + "', '" + LOWER + "'), '[^a-z0-9]+', ' ', 'g'))"
    bigrams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))])"
    return f"""
WITH templates AS (
  SELECT license, {bigrams} AS b FROM (SELECT license, string_split({clean.format("text")}, ' ') AS w FROM (VALUES {values}) t(license, text))),
units AS (
  SELECT doc_id, line, string_split({clean.format("t")}, ' ') AS w FROM (
    SELECT doc_id, CAST(-1 AS INTEGER) AS line, text AS t FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT doc_id, CAST(i - 1 AS INTEGER), ls[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), LATERAL unnest(range(1, len(ls) + 1)) r(i) WHERE len(ls) > 1)),
sized AS (SELECT doc_id, line, {bigrams} AS b FROM units),
scored AS (
  SELECT s.doc_id, s.line, t.license, 2.0::DOUBLE * len(list_intersect(s.b, t.b)) / (len(s.b) + len(t.b)) AS dice
  FROM sized s JOIN templates t ON len(s.b) > 0),
best AS (SELECT * FROM scored WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1),
docs AS (
  SELECT doc_id, list(license ORDER BY dice DESC, line, license) AS l, list(dice ORDER BY dice DESC, line, license) AS d,
    list(line ORDER BY dice DESC, line, license) AS n FROM best GROUP BY doc_id)
SELECT documents.doc_id, l[1] AS license, d[1] AS dice, n[1] AS line, CAST(coalesce(len(l), 0) AS INTEGER) AS n_matches,
  coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') AS licenses
FROM documents LEFT JOIN docs ON documents.doc_id = docs.doc_id
"""


ORACLE = _oracle()
