"""How filters interact, for every order in which they could be applied, by edges of the lattice of applied subsets.

What a filter meets depends only on which filters ran before it, not on their order. Five filters have 16 subsets each that
may have run before, 80 edges (subset, next filter) in all, and every step of each of the 120 orders is one of these edges.

  1. Each document's failures are a mask of five bits. Documents are counted by (part, mask, good, toxic), which leaves
     128 rows for a part at most, whatever the input.
  2. Every mask contributes to the 80 edges: documents that come that far and fail are removed there, those that fail but
     went before are redundant.
  3. The edges are joined with the 600 steps of all orders. A filter's removals over all orders are its edges' removals,
     weighted by the number of orders that pass the edge.

Failing as a copy takes the smallest doc_id of each text: documents are counted by (text's digest, part, good, toxic), and
the least of all rows of a digest is found among these few; no group of copies is gathered.

Cases: a null text is an empty one, and all empty texts are equal. A null lang is the part "". A row without doc_id is no
copy of any other and none is a copy of it; it has no labels. Rows of one doc_id and one text are not copies of each other.
Rows that share a doc_id each count; labels of one doc_id count as good (toxic) if one of them says so. Other columns are
ignored, whatever their names. An empty table gives an empty result; without labels nothing is good or toxic.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.names import chosen

# The filters' thresholds.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> Column:
    """The bits of A, B, C and D for a text that is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    failed = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters they fail; bit i of ``mask`` is filter i."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = chosen(docs, id_col, text_col, part_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"))
    said = chosen(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    said = said.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    no = F.lit(False)
    known = rows.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # Without id: counted apart, as they are neither labelled nor copies.
    nameless = rows.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", no.alias("good"), no.alias("toxic"), "n")
    each = known.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("k"))
    few = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("k").alias("n"), F.min("doc_id").alias("least"), F.min_by("k", "doc_id").alias("k"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("k")).otherwise(F.lit(0))
    split = few.withColumn("first", first).groupBy("part", "mask", "good", "toxic").agg(F.sum("first").alias("first"), F.sum("n").alias("n"))
    copy = F.lit(1 << FILTERS.index("E"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x")
    counted = split.select("part", both, "good", "toxic").select("part", "x.mask", "good", "toxic", "x.n")
    return counted.union(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(masks: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, applied, filter) and the counts of every edge of every part, zeros included. ``applied`` is a mask, ``shapley``
    the filter's removals over all orders."""
    all_edges = [(s, f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(factorial(bin(s).count("1")) * factorial(filters - 1 - bin(s).count("1"))).alias("orders")) for s, f in all_edges])).alias("e")
    rows = masks.select("*", each).select("part", "mask", "good", "toxic", "n", "e.*")
    own = F.expr("shiftleft(1, filter)")
    alive, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(own) != 0

    def n(where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(F.lit(0))).alias(name)

    out = rows.groupBy("part", "applied", "filter", "orders").agg(
        n(alive & ~fails, "kept"), n(alive & fails, "removed"), n(~alive & fails, "redundant"), n(F.col("mask") == own, "unique_fails"),
        n(alive & fails & F.col("good"), "good_lost"), n(alive & fails & F.col("toxic"), "toxic_lost"),
    )
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))  # 16 rows
    return out.withColumn("shapley", shapley).drop("orders")


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, filter) of all orders."""
    rows = [("".join(order), i + 1, sum(1 << filters.index(x) for x in order[:i]), filters.index(x)) for order in permutations(filters) for i, x in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order for each part."""
    found = edges(masks(docs, labels))
    out = found.join(steps(docs.sparkSession), ["applied", "filter"])
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in COUNTS])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(l) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(l)) < 80 * len(l) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN said ON said.doc_id = w.doc_id),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, o[:s - 1] AS before, o[s] AS x FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
met AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS bad,
    fails = '' OR before = '' OR NOT regexp_matches(fails, '[' || CASE WHEN before = '' THEN 'Z' ELSE before END || ']') AS alive FROM masks, steps),
counts AS (
  SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (alive AND NOT bad), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (alive AND bad), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (bad AND NOT alive), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (alive AND bad AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (alive AND bad AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counts
"""
