"""Exact top-k search by inner product over a bit-sliced index.

Every component is quantised to an integer. A block of rows is stored as slices: for each attribute and each bit of its
two's complement, a bitmap over the block's rows (the top bit weighs negatively). For a query the score of all rows of a
block is a sum of slices: each set bit of a query component adds the attribute's slices, shifted. Slices of one weight are
added three at a time by carry-save adders, bitmaps in, bitmaps out, until one slice is left for each bit of the score.
Selection goes from the most significant slice down: rows with the bit set are taken if no more than k, else the search
goes on among them; the rows still tied at the last slice have equal scores, and the smallest ids of them are taken.

The index holds every row. Queries are a stated set; query blocks meet groups of row blocks, each pair once, and the best
of a group go on to the next step.

Cases: vectors that are null, or hold null or non-finite components, take no part; an empty vector scores 0. A shorter
vector counts as filled up with zeros. A block has as many slices as its largest component needs, and sums are as wide as
they need to be: scores are exact, however large the components. A component that leaves 62 bits, or a result's score that
leaves 64, is an error, never another number. Rows with a null id take no part. Rows that share an id are rows of their
own: each is a candidate of the other, and each query row has its own ranks. Ties fall to the smaller id. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.names import numbered
from skein.scratch import written

#: Rows of an index block (a multiple of 64) and queries of a query block.
ROWS, QUERIES = 8192, 512
#: Components and scores have to stay below.
LARGEST, LARGEST_SCORE = 1 << 62, 1 << 63
#: Groups of row blocks for each core; query blocks are sent once to each group.
GROUPS = 4
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of sound vectors."""
    plain, of = numbered(vectors)
    vec_id, vector = F.col(of(id_col)).cast("long"), F.col(of(vector_col))
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = vector.isNotNull() & vec_id.isNotNull() & F.forall(F.coalesce(x, F.array().cast("array<double>")), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    too_large = F.raise_error(F.lit("a quantised component leaves 62 bits")).cast("long")
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < float(LARGEST), F.floor(c * scale).cast("long")).otherwise(too_large))
    return plain.filter(sound).select(vec_id.alias("vec_id"), x.alias("x")).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offs = column.offsets.to_numpy()
    values = column.values.to_numpy()
    sizes = np.diff(offs)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], sizes)] = values[offs[0] : offs[-1]]
    return out


def slice_rows(v: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words) bitmaps of a block of quantised rows."""
    n, width = v.shape
    padded = np.zeros((-(-n // 64) * 64, width), np.int64)
    padded[:n] = v
    out = np.empty((width, bits, len(padded) // 64), np.uint64)
    for j in range(bits):
        bit = np.ascontiguousarray((padded >> j & 1).astype(np.uint8).T)
        out[:, j] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
    return out


def score_slices(slices: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner products of all rows as (bits, words), two's complement, the last the sign.

    With s = sum over i, j of q_i v_j 2^(i+j), a negative addend -x 2^w is (~x) 2^w - 2^w; the constants are added once.
    """
    width, bits, words = slices.shape
    top = sum(abs(int(q)) for q in query).bit_length() + bits + 1
    pools: list[list[np.ndarray]] = [[] for _ in range(top)]
    constant = 0
    digits: dict[tuple[int, int], list[int]] = {}
    for a in np.flatnonzero(query):
        q, i = int(query[a]), 0
        while q:  # signed digits, no two of them adjacent
            if q & 1:
                d = 2 - (q & 3)
                digits.setdefault((i, d), []).append(int(a))
                q -= d
            q >>= 1
            i += 1
    for (i, d), attributes in digits.items():
        for j in range(bits):
            found = slices[attributes, j]
            if (d < 0) != (j == bits - 1):
                found = ~found
                constant -= len(attributes) << (i + j)
            if i + j < top:
                pools[i + j].append(found)
    out = np.zeros((top, words), np.uint64)
    for w in range(top):
        if constant >> w & 1:
            pools[w].append(np.full((1, words), ONES))
        pool = np.concatenate(pools[w]) if pools[w] else np.zeros((0, words), np.uint64)
        carried = []
        while len(pool) > 1:
            if len(pool) == 2:
                a, b = pool[:1], pool[1:]
                carried.append(a & b)
                pool = a ^ b
                break
            m = len(pool) // 3
            a, b, c = pool[:m], pool[m : 2 * m], pool[2 * m : 3 * m]
            half = a ^ b
            carried.append((a & b) | (half & c))
            pool = np.concatenate([half ^ c, pool[3 * m :]])
        if len(pool):
            out[w] = pool[0]
        if w + 1 < top:
            pools[w + 1] += carried
    return out


def _count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def select_top(scores: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that surely belong to the top k, and of the rows tied at the boundary."""
    sure, open_, left = np.zeros_like(among), among, k
    if _count(open_) <= k:
        return _places(open_), np.zeros(0, np.int64)
    for w in range(len(scores) - 1, -1, -1):
        high = open_ & (~scores[w] if w == len(scores) - 1 else scores[w])
        n = _count(high)
        if n > left:
            open_ = high
        else:
            sure |= high
            left -= n
            open_ = open_ & ~high
        if not left:
            return _places(sure), np.zeros(0, np.int64)
    return _places(sure), _places(open_)


def score_at(scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = scores[:, places // 64] >> (places % 64).astype(np.uint64) & np.uint64(1)
    out = []
    for row in bits.T.tolist():
        score = sum(bit << w for w, bit in enumerate(row)) - (row[-1] << len(row))
        if not -LARGEST_SCORE <= score < LARGEST_SCORE:
            raise OverflowError(f"a score leaves 64 bits: {score}")
        out.append(score)
    return np.array(out, np.int64)


def bits_of(v: np.ndarray) -> int:
    """Bits of two's complement that hold every number."""
    return max(int(v.max(initial=0)).bit_length(), (~int(v.min(initial=0))).bit_length()) + 1


def _build(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, uid, v), ascending by id in the partition, to blocks (ids, uids, bits, slices)."""
    ids, uids, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)

    def made(n: int) -> pa.RecordBatch:
        bits = bits_of(rows[:n])
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids[:n], uids[:n], slice_rows(rows[:n], bits))]
        return pa.RecordBatch.from_arrays([*blobs[:2], pa.array([bits], pa.int32()), blobs[2]], ["ids", "uids", "bits", "slices"])

    for batch in batches:
        ids, uids = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([uids, batch.column(1).to_numpy()])
        rows = np.concatenate([rows, _matrix(batch.column(2), width)])
        while len(ids) >= ROWS:
            yield made(ROWS)
            ids, uids, rows = ids[ROWS:], uids[ROWS:], rows[ROWS:]
    if len(ids):
        yield made(len(ids))


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the index over rows (vec_id, uid, v) at rest, and the number of attributes."""
    width, n = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width = max(width or 0, 1)
    dealt = vectors.select("vec_id", "uid", "v").repartitionByRange(max(1, -(-n // (4 * ROWS))), "vec_id", "uid").sortWithinPartitions("vec_id", "uid")
    return written(dealt.mapInArrow(partial(_build, width=width), "ids binary, uids binary, bits int, slices binary"), "index"), width


def _search(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(ids, uids, bits, slices, query_ids, query_uids, queries) to (query_id, query_uid, vec_id, score)."""

    def longs(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_buffer(), np.int64)

    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for row in range(batch.num_rows):
            ids, uids, query_ids, query_uids = (longs(batch, c, row) for c in ("ids", "uids", "query_ids", "query_uids"))
            slices = np.frombuffer(batch.column("slices")[row].as_buffer(), np.uint64).reshape(width, batch.column("bits")[row].as_py(), -1)
            queries = longs(batch, "queries", row).reshape(len(query_ids), width)
            there = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            for query_id, query_uid, query in zip(query_ids, query_uids, queries, strict=True):
                among = there
                low, high = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
                for own in low + np.flatnonzero(uids[low:high] == query_uid):
                    among = there.copy()
                    among[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
                scores = score_slices(slices, query)
                sure, tied = select_top(scores, among, k)
                chosen = np.concatenate([sure, tied[: k - len(sure)]])  # ids ascend within a block
                out[0].append(np.full(len(chosen), query_id))
                out[1].append(np.full(len(chosen), query_uid))
                out[2].append(ids[chosen])
                out[3].append(score_at(scores, chosen))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "query_uid", "vec_id", "score"])


def _query_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, QUERIES):
            part = batch.slice(a, QUERIES)
            blobs = [part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(pa.concat_arrays([part.column(2)]), width)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["query_ids", "query_uids", "queries"])


def search(index: DataFrame, width: int, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score for every query (vec_id, uid, v)."""
    spark = index.sparkSession
    groups = min(max(index.count(), 1), GROUPS * spark.sparkContext.defaultParallelism)
    rows = queries.select("vec_id", "uid", "v").repartition(max(1, -(-queries.count() // QUERIES))).sortWithinPartitions("vec_id", "uid")
    pages = rows.mapInArrow(partial(_query_blocks, width=width), "query_ids binary, query_uids binary, queries binary")
    # Every query block is dealt to every group of row blocks.
    dealt = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    parts = index.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # Neither side may pass the driver: bitmaps at rest are far smaller than in memory, and each query block is there many times.
    found = parts.join(dealt.hint("merge"), "part").drop("part").mapInArrow(partial(_search, width=width, k=k), "query_id long, query_uid long, vec_id long, score long")
    # Spark keeps the k best of each query in a task before it shuffles them.
    best = Window.partitionBy("query_id", "query_uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows of every row whose id is divisible by ``every``."""
    rows = written(quantised(vectors, id_col, vector_col, scale).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    index, width = build_index(rows)
    return search(index, width, rows.filter(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH q AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.uid <> b.uid)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
