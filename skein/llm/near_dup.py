"""Near-duplicate documents by min-max hashing.

Lower-cased words give a document's set of five-word shingles. One evaluation of each permutation yields two values,
its minimum and its maximum over the set; bands of four values from different permutations bucket the sets, so that
half the permutations do the work. Two documents of similarity 0.75 share none of the 36 bands with a chance of about
1e-6. Every link is confirmed on full sets.

Steps, each bounded in what one task holds:
  1. signatures, one pass over the text; equal sets become one vertex, the smallest doc_id that has the set;
  2. buckets with more than one vertex; every member is compared with the bucket's least (a star, not all pairs), a
     vertex of many pairs in several tasks;
  3. components of the confirmed links; buckets that still hold several components are searched again for pairs across
     components, by bin sketches that travel with the members (large buckets in blocks, of which those of one component
     do not meet); what the sketches leave open is confirmed on full sets; a pair within one component is never made;
  4. components of all links.

Cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer than five words has its
whole sequence as one shingle. Rows with one doc_id count as one document, whose sets are joined. A row without doc_id
takes no part: its component is null and it is kept. Ties fall to the smallest doc_id. Other columns are ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import shingles
from skein.llm.memory import released
from skein.llm.names import chosen, numbered
from skein.operators.components import connected
from skein.scratch import written

#: A link needs 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 75
#: Members of a bucket compared at once; a larger bucket is cut into blocks.
BUCKET_BLOCK = 1024
#: Edges that one task takes of an end with more, and how many such ends are sent to all executors (24 bytes each).
HUB, BROADCAST_HUBS = 512, 200_000
#: Bits of the filter that keeps texts without candidates out of the shuffle: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, block_a, block_b, side, v, c, n, sketch, bands) sorted by the first three: pairs across components.

    Two vertices may share several bands; their pair is made in the first of them alone.
    """
    left: pa.Table | None = None

    def pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
        v, c, n = (rows.column(k).to_numpy() for k in ("v", "c", "n"))
        side = rows.column("side").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(v), shingles.BINS)
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(v)]])
        bands = rows.column("bands").chunk(0).flatten().to_numpy().reshape(len(v), shingles.BANDS)

        def made_here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            first = (bands[x] == bands[y]).argmax(axis=1)
            return bands[x, first] == keys[0, x]

        two = starts[ends - starts == 2]
        two = two[(c[two] != c[two + 1]) & ((keys[1, two] == keys[2, two]) | (side[two] != side[two + 1]))]
        if len(two):
            two = two[made_here(two, two + 1)]
            two = two[shingles.may_reach(sketch[two], sketch[two + 1], n[two], n[two + 1], LINK_PERCENT / 100)]
            yield v[two], v[two + 1]
        for s, e in zip(starts, ends, strict=True):
            if e - s <= 2:
                continue
            same_block = keys[1, s] == keys[2, s]
            first = np.arange(s, e) if same_block else np.arange(s, e)[side[s:e] == 0]
            for i in first:
                others = np.arange(i + 1, e) if same_block else np.arange(s, e)[side[s:e] == 1]
                others = others[c[others] != c[i]]
                others = others[made_here(np.full(len(others), i), others)]
                if len(others):
                    hit = others[shingles.may_reach(sketch[others], sketch[i], n[others], n[i], LINK_PERCENT / 100)]
                    if len(hit):
                        yield np.full(len(hit), v[i]), v[hit]

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = list(pairs(rows.combine_chunks())) if rows.num_rows else []
        if found:
            x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]) if left is not None else rows
        if not rows.num_rows:
            continue
        keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
        whole = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        at = int(whole[-1]) + 1 if len(whole) else 0
        yield from made(rows.slice(0, at))
        left = rows.slice(at)
    if left is not None:
        yield from made(left)


def _with_sets(edges: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """``edges`` with the set of one of their ends. An end of many edges is dealt to several tasks, its set to each."""
    hubs = edges.groupBy(F.col(end).alias("hub")).agg(F.count("*").alias("k")).filter(F.col("k") > HUB)
    hubs = written(hubs.select("hub", F.ceil(F.col("k") / HUB).cast("long").alias("k")), "hubs")
    n = hubs.count()
    sets = sets.select(F.col("v").alias(end), F.col("shingles").alias(name))
    if not n:
        return edges.join(sets, end)
    few = F.broadcast(hubs) if n <= BROADCAST_HUBS else hubs
    dealt = edges.join(few, F.col(end) == F.col("hub"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("k")), F.lit(0).cast("long"))).drop("hub", "k")
    copies = sets.join(few, F.col(end) == F.col("hub"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1).cast("long")) - 1))).drop("hub", "k")
    return dealt.join(copies, [end, "salt"]).drop("salt")


def _confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of distinct ``edges`` (a, b) whose full sets are similar enough."""
    edges = written(edges, "pairs")
    both_sets = _with_sets(_with_sets(edges, sets, "a", "x"), sets, "b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return both_sets.withColumn("both", both).filter(100 * F.col("both") >= LINK_PERCENT * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _bit_table(ids: DataFrame) -> DataFrame:
    """(word, bits): which hashes occur among ``v``. At most FILTER_BITS / 64 rows, whatever the input."""
    place = F.pmod(F.xxhash64("v"), F.lit(FILTER_BITS)).alias("p")
    return ids.select(place).groupBy(F.shiftright("p", 6).cast("int").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("_bits"))


def _marked(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` with ``_hit``: false only where the id is null or surely not among ``ids``. By broadcast of the bit table."""
    place = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_BITS))
    placed = docs.withColumns({"_word": F.shiftright(place, 6).cast("int"), "_bit": (place % 64).cast("int")})
    # A null id has a hash too, whose bit others may have set.
    hit = F.col(id_col).cast("long").isNotNull() & F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1 = 1"), F.lit(False))
    return placed.join(F.broadcast(_bit_table(ids)), "_word", "left").withColumn("_hit", hit).select(*docs.columns, "_hit")


def _sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Full sets and bin sketches of the vertices in ``members``.

    The bit table keeps most texts that are not needed out of the work; the exact join follows.
    """
    need = members.select("v").distinct().join(nodes.select(F.col("first").alias("v"), "set_key", "bands"), "v")
    wanted = _marked(docs.select("doc_id", "text"), "doc_id", need).filter("_hit").select("doc_id", "text")
    sets = wanted.mapInArrow(lambda b: released(shingles.set_batches(b)), "doc_id long, set_key binary, shingles array<long>, sketch binary")
    found = sets.join(need.withColumnRenamed("v", "doc_id"), ["doc_id", "set_key"])
    return found.select(F.col("doc_id").alias("v"), "shingles", "sketch", "bands", F.size("shingles").cast("long").alias("n"))


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows (band, v, c) of buckets that hold several components, with ``m``: the pairs of blocks that each takes part in.

    A component of more than BUCKET_BLOCK members in a bucket has blocks of its own, which need not meet each other; all
    others share blocks, which meet themselves and all.
    """
    sizes = written(placed.groupBy("band", "c").agg(F.count("*").alias("k")), "sizes")
    large = sizes.filter(F.col("k") > BUCKET_BLOCK).select("band", "c", F.ceil(F.col("k") / BUCKET_BLOCK).cast("int").alias("own_parts"))
    per_band = sizes.groupBy("band").agg(F.count("*").alias("components"), F.sum(F.when(F.col("k") <= BUCKET_BLOCK, F.col("k"))).alias("rest"), F.sum(F.when(F.col("k") > BUCKET_BLOCK, F.ceil(F.col("k") / BUCKET_BLOCK))).alias("large"))
    shared = F.ceil(F.coalesce("rest", F.lit(0)) / BUCKET_BLOCK).cast("int")
    open_ = per_band.filter("components > 1").select("band", shared.alias("parts"), (shared + F.coalesce("large", F.lit(0))).cast("int").alias("all_parts"))
    before = F.coalesce(F.sum("own_parts").over(Window.partitionBy("band").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    large = large.withColumn("skipped", before)
    rows = placed.join(open_, "band").join(large, ["band", "c"], "left")
    first = F.when(F.col("own_parts").isNull(), F.lit(0)).otherwise(F.col("parts") + F.col("skipped"))
    rows = rows.withColumn("first", first).withColumn("own", (F.col("first") + F.pmod(F.xxhash64("v"), F.coalesce("own_parts", "parts").cast("long"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all_parts") - 1), lambda j: F.col("own_parts").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("own_parts")))
    # A pair of blocks has the lower on its left side.
    meets = F.transform(others, lambda j: F.struct(F.least(F.col("own"), j).alias("block_a"), F.greatest(F.col("own"), j).alias("block_b"), (F.col("own") > j).cast("int").alias("side")))
    return rows.withColumn("m", F.explode(meets)).select("band", "m.*", "v", "c")


def _search_across(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs between different components that meet in a bucket."""
    placed = members.select("band", "v").join(labels, "v", "left").select("band", "v", F.coalesce("c", "v").alias("c"))
    rows = _blocks(placed).join(sets.select("v", "n", "sketch", "bands"), "v").select("band", "block_a", "block_b", "side", "v", "c", "n", "sketch", "bands")
    dealt = rows.repartition("band", "block_a", "block_b").sortWithinPartitions("band", "block_a", "block_b")
    return dealt.mapInArrow(lambda b: released(_across(b)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    narrow = chosen(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(narrow.mapInArrow(lambda b: released(shingles.sketch_batches(b)), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    known = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "nodes")
    in_bands = nodes.select(F.explode("bands").alias("band"), F.col("first").alias("v"))
    shared = in_bands.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo < hi").select("band", "lo")
    members = written(in_bands.join(shared, "band"), "members")
    sets = written(_sets(narrow, nodes, members), "sets")
    star = members.filter("v <> lo").select(F.col("lo").alias("a"), F.col("v").alias("b")).distinct()
    links = written(_confirmed(star, sets), "links")
    across = _search_across(members, connected(links), sets).join(star, ["a", "b"], "left_anti")
    more = written(_confirmed(across, sets), "links")
    firsts = nodes.select("set_key", "first")
    # Sets that share a doc_id: only where doc_ids repeat.
    repeated = known.select("doc_id", "set_key").join(known.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"), "doc_id", "left_semi")
    own = repeated.join(firsts, "set_key").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    labels = connected(links.union(more).union(own))
    out = signed.select("doc_id", "n_shingles", "set_key").join(firsts, "set_key", "left").join(labels.withColumnRenamed("v", "first"), "first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "first", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: its smallest id. Rows without id stay. Of rows that share an id the one stays whose
    text is least (null before all), then whose columns, written as JSON, are. Columns of any name are returned as they came.

    Only rows that may have to go (by the bit table of dropped and repeated ids) are joined exactly; the rest of the texts
    is not shuffled.
    """
    plain, of = numbered(docs)
    own_id, text = of(id_col), of(text_col)
    found = near_duplicates(plain, own_id, text).filter("doc_id IS NOT NULL")
    found = written(found.groupBy(F.col("doc_id").alias("v")).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")), "kept")
    marked = _marked(plain, own_id, found.filter("NOT kept OR n > 1"))
    sure = marked.filter("NOT _hit").drop("_hit")
    unsure = marked.filter("_hit").drop("_hit").join(found.filter("kept").select(F.col("v").alias("_kept"), F.col("n").alias("_n")), F.col(own_id).cast("long") == F.col("_kept"))
    parts = sure.unionByName(unsure.filter("_n = 1").drop("_kept", "_n"))
    if not found.filter("kept AND n > 1").isEmpty():
        row = F.struct(*[F.col(c) for c in plain.columns])
        least = unsure.filter("_n > 1").groupBy("_kept").agg(F.min_by(row, F.struct(F.col(text), F.to_json(row))).alias("r"))
        parts = parts.unionByName(least.select("r.*"))
    return parts.toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_distinct([array_to_string(l[i:i + 4], ' ') for i in range(1, len(l) - 3)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
c AS (SELECT x AS doc_id, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
