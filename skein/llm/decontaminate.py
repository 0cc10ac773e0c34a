"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions.

A benchmark item is cut into windows of ten consecutive words (an item of fewer is one window), a window into shingles of
five. A window occurs in a document only if all its shingles do, so one of them, its prefix, is enough to find it: the
shingle that is rarest in the corpus.

  1. One pass over the texts: a document's shingles are tested against a bit table of all items' shingles (at most 2 MB,
     whatever the benchmark), and the stretches of words whose shingles pass are written, with the document's number of
     words. Nothing else of a text goes on; a false pass costs a few words.
  2. Shingles are counted over these stretches, which hold every occurrence in the corpus of every item's shingle. A
     window with a shingle that never occurs is done with; of the others the rarest shingle is the prefix.
  3. Positions that bear a prefix join the windows of that prefix. The window's length and the place of the prefix within
     it say where it would begin and end; candidates that leave the stretch are dropped, and the rest compared word by word.
  4. Spans of one document are merged for its number of hit words.

Words are runs of a-z, 0-9 and all characters beyond ASCII, A-Z lower-cased.

Cases: a null, empty or wordless text has no words and no hits. Rows of one doc_id are rows of their own, each with its own
answer, and a null doc_id is kept. An item without id or words takes no part; rows that share an item_id are one item with
the windows of all. Equal windows of several items are looked for once and count for each item. Other columns are ignored,
whatever their names; an empty table of documents gives an empty result, without items no document has a hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.license_scan import _let as let
from skein.llm.names import chosen
from skein.llm.sharding import longs
from skein.llm.url_filter import LOWER, UPPER
from skein.scratch import written

WINDOW, SHINGLE = 10, 5
#: Bits of the bit tables for each key, and at most (2 MB).
BITS_PER_KEY, MOST_BITS = 32, 1 << 24
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    # Lower-casing is cheap where all is ASCII; elsewhere only A-Z may change.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BREAK), "")


def _key(words: Column, at: Column, width: int) -> Column:
    """The 64-bit key of the ``width`` words from ``at`` (from 0)."""
    return F.xxhash64(F.lit(width), F.slice(words, at + 1, width))


def _keys(words: Column, width: int) -> Column:
    """The keys of all runs of ``width`` words, of which there is one at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: _key(words, i, width))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


class Bits:
    """A bit table of 64-bit keys, in which a key has two places."""

    def __init__(self, keys: DataFrame, col: str):
        keys = keys.select(F.col(col).alias("k")).distinct()
        n = keys.count()
        self.size = max(64, min(MOST_BITS, 1 << max(0, n * BITS_PER_KEY - 1).bit_length()))
        at = F.explode(F.array(*self._places(F.col("k")))).alias("at")
        rows = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).collect()
        self.words = [0] * (self.size // 64)
        for r in rows:
            self.words[r["word"]] = r["bits"]

    def _places(self, key: Column) -> list[Column]:
        return [key.bitwiseAND(F.lit(self.size - 1).cast("long")), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(self.size - 1).cast("long"))]

    def holds(self, key: Column) -> Column:
        first, second = (F.bit_get(F.element_at(longs(self.words), (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for at in self._places(key))
        return first & second


def _windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, window_id) and (window_id, window, width): distinct windows, ``width`` their shingles' number of words."""
    lists = items.select("item_id", words_of(F.col("text")).alias("words")).filter("item_id IS NOT NULL AND size(words) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))), lambda i: F.slice("words", i + 1, WINDOW))
    # No word holds a space, so the joined words are the window's own.
    rows = lists.select("item_id", F.explode(cut).alias("window")).withColumn("window_id", F.sha2(F.array_join("window", " "), 256))
    rows = written(rows.distinct(), "item_windows")
    windows = rows.select("window_id", "window", F.least(F.size("window"), F.lit(SHINGLE)).alias("width")).distinct()
    return rows.select("item_id", "window_id").distinct(), windows


def _shingles(windows: DataFrame, widths: list[int]) -> DataFrame:
    """(window_id, offset, key) of every shingle of every window."""
    return _union([windows.filter(F.col("width") == k).select("window_id", F.posexplode(_keys(F.col("window"), k)).alias("offset", "key")) for k in widths])


def _stretches(words: Column, bits: Bits, width: int) -> Column:
    """(width, at, words): maximal runs of neighbouring shingles that pass the bit table."""

    def runs(hits: Column) -> Column:
        starts = F.filter(hits, lambda x, i: (i == 0) | (F.get(hits, i - 1) != x - 1))
        ends = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(F.lit(width).alias("width"), s.alias("at"), F.slice(words, s + 1, e - s + width).alias("words")))

    passed = F.filter(F.transform(words, lambda w, i: F.when((i <= F.size(words) - width) & bits.holds(_key(words, i, width)), i)), lambda i: i.isNotNull())
    return let(passed, lambda hits: F.when(F.size(hits) > 0, runs(hits)))


def _candidates(stretches: DataFrame, bits: Bits, width: int) -> DataFrame:
    """(row_id, at, first, around, key) of the positions ``at`` that may bear a prefix, with up to a window's words on
    either side; ``first`` is the position of the first of these."""
    own = stretches.filter(F.col("width") == width)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - width), lambda i: bits.holds(_key(F.col("words"), i, width)))
    reach = WINDOW - width
    rows = own.select("row_id", F.col("at").alias("base"), F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.greatest(i - reach, F.lit(0)).alias("first"), F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + WINDOW).alias("around"), _key(F.col("words"), i, width).alias("key")))).alias("x"))
    return rows.select("row_id", (F.col("base") + F.col("x.i")).alias("at"), (F.col("base") + F.col("x.first")).alias("first"), "x.around", "x.key")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (row_id, doc_id, n_words) of every document; (row_id, start, length, window_id) of every occurrence of
    a window, in words from 0; and (item_id, window_id) of the items."""
    docs = chosen(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held, windows = _windows(chosen(items, item_id_col, item_text_col).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")))
    widths = [r[0] for r in windows.select("width").distinct().orderBy("width").collect()]  # SHINGLE at most
    listed = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    if not widths:
        base = written(listed.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.size("words").cast("long").alias("n_words")), "rows")
        return base, base.select("row_id", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window_id")).filter("false"), held
    shingles = written(_shingles(windows, widths), "shingles")
    by_width = shingles.join(windows.select("window_id", "width"), "window_id")
    tables = {k: Bits(by_width.filter(F.col("width") == k), "key") for k in widths}
    found = F.concat(*[F.coalesce(_stretches(F.col("words"), tables[k], k), F.array().cast("array<struct<width:int,at:int,words:array<string>>>")) for k in widths])
    base = written(listed.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("stretches")), "rows")
    stretches = base.select("row_id", F.explode("stretches").alias("s")).select("row_id", "s.*")
    borne = _union([stretches.filter(F.col("width") == k).select(F.explode(_keys(F.col("words"), k)).alias("key")) for k in widths])
    counts = written(borne.groupBy("key").agg(F.count("*").alias("n")), "counts")
    ranked = shingles.join(counts, "key", "left").groupBy("window_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("rarest"), F.min_by(F.struct("key", "offset"), F.struct("n", "key", "offset")).alias("prefix"))
    prefixes = written(ranked.filter("rarest > 0").join(windows, "window_id").select("prefix.*", "window_id", "window", "width"), "prefixes")
    candidates = _union([_candidates(stretches, Bits(prefixes.filter(F.col("width") == k), "key"), k) for k in widths])
    start, length = F.col("at") - F.col("offset"), F.size("window")
    met = candidates.join(prefixes, "key").filter((start >= F.col("first")) & (start + length <= F.col("first") + F.size("around")))
    same = F.slice("around", start - F.col("first") + 1, length) == F.col("window")
    return base.select("row_id", "doc_id", "n_words"), met.filter(same).select("row_id", start.alias("start"), length.alias("length"), "window_id").distinct(), held


def contamination(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items with occurring windows, as sorted strings) of every row of ``docs``."""
    base, spans, held = occurrences(docs, items, **names)
    spans = written(spans, "spans")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("row_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("row_id", "start", "length").distinct().withColumn("new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
    hits = fresh.groupBy("row_id").agg(F.sum("new").alias("hit_"))
    owned = spans.select("row_id", "window_id").join(held, "window_id").select("row_id", F.col("item_id").cast("string").alias("item_id")).distinct()
    owned = owned.groupBy("row_id").agg(F.array_sort(F.collect_list("item_id")).alias("items_"))
    out = base.join(hits, "row_id", "left").join(owned, "row_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("hit_", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items_", F.array().cast("array<string>")).alias("items"))


def contaminated_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the contract, with items as a digest."""
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS t, least(len(w), 10) AS n FROM i, LATERAL unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(s) WHERE len(w) > 0 AND item_id IS NOT NULL),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM d, sizes, LATERAL unnest(range(1, len(w) - n + 2)) r(s)),
met AS (SELECT p.doc_id, p.n, p.s, x.item_id FROM places p JOIN windows x ON p.t = x.t AND p.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM (SELECT DISTINCT doc_id, n, s FROM met), LATERAL unnest(range(0, n)) r(k) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN owned ON owned.doc_id = d.doc_id
"""
