"""Sharding along a Hilbert curve, with DataFrame functions only.

Every metadata dimension is quantised to a few bits at cuts of near equal mass, found over all rows and whole values:
quantiles by Spark's mergeable sketch for numbers, dates and times, and a descent along prefixes for strings, which splits
whatever range of values holds a cut until it is light or a single value. The cell's place on the Hilbert curve is read from
a constant table. Rows are ranked along the curve and the ranks are cut into runs of near equal counts. A shard is thus
compact in all dimensions at once, and the ranges in ``manifest`` let a reader skip it on any of them.

No sort or count is global: ranks come from counts of cells (at most 65,536 and some parts), and a cell that holds many
rows is ranked in parts. Cases: null is a value of its own, before all others; not-a-number is after all others; a value
that many rows share gets one code, and others then have fewer; ties are broken by doc_id, the text's checksum and the row's
place in the input; repeated rows get places of their own; an empty table gives an empty result. Own columns that bear a
result's name (in any case) are kept with ``own_`` before it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.names import chosen, numbered, with_results
from skein.scratch import written

#: A cell with more than this share of all rows, and more than so many, is ranked in parts.
PART_SHARE, PART_ROWS = 1 / 1024, 4096
#: A range of strings is split if it holds a cut and more than this share of all rows.
LIGHT = 1 / 256
#: How finely the sketch of numbers is kept: ranks are off by at most one in so many.
ACCURACY = 10_000


def hilbert_order(dims: int, bits: int) -> np.ndarray:
    """The curve index of every cell; a cell is its coordinates' bits, first dimension highest.

    The curve of n dimensions is walked by reflected Gray codes; entry point and direction of every sub-cube follow from
    the Gray code's last changes.
    """
    n, full = dims, (1 << dims) - 1
    cells = np.arange(1 << (dims * bits))
    axes = [(cells >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)]
    entry, turn, out = np.zeros_like(cells), np.zeros_like(cells), np.zeros_like(cells)

    def right(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        return ((x >> k) | (x << (n - k))) & full

    def left(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        return ((x << k) | (x >> (n - k))) & full

    def trailing_ones(x: np.ndarray) -> np.ndarray:
        count, going = np.zeros_like(x), np.ones_like(x, bool)
        for k in range(n):
            going &= (x >> k) & 1 == 1
            count += going
        return count

    for level in range(bits - 1, -1, -1):
        corner = sum((axis >> level & 1) << i for i, axis in enumerate(axes))
        gray = right(corner ^ entry, (turn + 1) % n)
        digit = gray.copy()
        for k in (1, 2, 4, 8):
            digit ^= digit >> k
        out = out << n | digit
        before = np.maximum(digit - 1, 0)
        even = before & ~np.int64(1)
        start = np.where(digit == 0, 0, even ^ even >> 1)
        step = np.where(digit == 0, 0, np.where(digit & 1, trailing_ones(digit), trailing_ones(before))) % n
        entry, turn = entry ^ left(start, (turn + 1) % n), (turn + step + 1) % n
    return out


def longs(values: list[int]) -> Column:
    """An array constant, written as text so that the plan holds one literal."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def _string_cuts(df: DataFrame, names: list[str], bits: int) -> dict[str, list[str]]:
    """For each string column the values (or prefixes) at which its next code begins, by descent along prefixes.

    A range is a prefix's rows, known by its least and greatest value and its number of rows. Each pass splits every range
    that holds a cut and is not light, by the two characters after what all its values share.
    """
    edge = df.agg(F.count("*"), *[f(n) for n in names for f in (F.min, F.max, F.count)]).first()
    total, ranges = edge[0], {n: [tuple(edge[1 + 3 * i : 4 + 3 * i])] for i, n in enumerate(names)}
    targets = [k * total / (1 << bits) for k in range(1, 1 << bits)]

    def holding(n: str) -> list[tuple[float, int]]:
        """The places of the ranges that hold a cut, with the ranks before them; nulls come before all."""
        out, below = [], total - sum(c for _, _, c in ranges[n])
        for i, (_, _, c) in enumerate(ranges[n]):
            if any(below < t < below + c for t in targets):
                out.append((below, i))
            below += c
        return out

    def shared(lo: str, hi: str) -> int:
        at = 0
        while at < min(len(lo), len(hi)) and lo[at] == hi[at]:
            at += 1
        return at

    while True:
        wide = {n: [i for _, i in holding(n) if ranges[n][i][0] != ranges[n][i][1] and ranges[n][i][2] > LIGHT * total] for n in names}
        if not any(wide.values()):
            break
        cases = []
        for d, n in enumerate(names):
            for i in wide[n]:
                lo, hi, _ = ranges[n][i]
                size = shared(lo, hi) + 2
                cases.append(F.when(F.col(n).between(lo, hi), F.struct(F.lit(d).alias("dim"), F.lit(i).alias("range"), F.substring(n, 1, size).alias("prefix"), F.col(n).alias("value"))))
        rows = df.select(F.explode(F.array_compact(F.array(*cases))).alias("x")).groupBy("x.dim", "x.range", "x.prefix").agg(F.min("x.value").alias("lo"), F.max("x.value").alias("hi"), F.count("*").alias("n")).collect()
        for d, n in enumerate(names):
            split = {i: sorted((r["lo"], r["hi"], r["n"]) for r in rows if r["dim"] == d and r["range"] == i) for i in wide[n]}
            ranges[n] = [part for i, whole in enumerate(ranges[n]) for part in split.get(i, [whole])]
    out = {}
    for n in names:
        starts, below = [], total - sum(c for _, _, c in ranges[n])
        for lo, _, c in ranges[n]:
            starts.append((below, lo))
            below += c
        # The range's start that is nearest to each cut; the first value needs no cut.
        cuts = {min(starts, key=lambda x: (abs(x[0] - t), x[0]))[1] for t in targets} if starts else set()
        out[n] = sorted(cuts - ({starts[0][1]} if starts and starts[0][0] == 0 else set()))
    return out


def _cuts(df: DataFrame, names: list[str], bits: int) -> dict[str, list]:
    """For each column the values at which its next code begins, at most 2^bits - 1 and near equal mass apart."""
    strings = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    out: dict[str, list] = _string_cuts(df, strings, bits) if strings else {}
    rest = [n for n in names if n not in out]
    if rest:
        shares = [k / (1 << bits) for k in range(1, 1 << bits)]
        row = df.agg(*[F.percentile_approx(n, shares, ACCURACY).alias(f"q{i}") for i, n in enumerate(rest)], *[F.min(n).alias(f"m{i}") for i, n in enumerate(rest)], *[F.count_if(F.col(n).isNull()).alias(f"z{i}") for i, n in enumerate(rest)]).first()
        for i, n in enumerate(rest):
            values = set(row[f"q{i}"] or []) | ({row[f"m{i}"]} if row[f"z{i}"] else set())
            out[n] = sorted(values - {None} - (set() if row[f"z{i}"] else {row[f"m{i}"]}), key=lambda v: (v != v, v))[: (1 << bits) - 1]
    return out


def _ordered(df: DataFrame, name: str) -> Column:
    """The column as a type whose quantiles Spark sketches, or as a string."""
    kind = df.schema[name].dataType
    plain = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.col(name) if isinstance(kind, plain) else F.col(name).cast("int") if isinstance(kind, T.BooleanType) else F.col(name).cast("string")


def hilbert_shards(df: DataFrame, dims: list[str], order: list[str], shards: int = 40, bits: int = 4) -> DataFrame:
    """``df`` with ``hilbert`` (curve index), ``shard`` and ``slot``; ``df`` should be narrow: it is shuffled by cell."""
    if len(dims) * bits > 16:
        raise ValueError("at most 65,536 cells")
    plain, of = numbered(df)
    names = [f"dim_{i}_" for i in range(len(dims))]
    rows = plain.withColumns({n: _ordered(plain, of(d)) for n, d in zip(names, dims, strict=True)}).withColumn("row_", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    cuts = _cuts(rows, names, bits)
    cell = F.lit(0)
    for n in names:
        level = reduce(add, [(F.col(n) >= F.lit(cut)).cast("int") for cut in cuts[n]], F.lit(0))
        cell = cell * (1 << bits) + F.coalesce(level, F.lit(0))
    placed = rows.withColumn("hilbert_", F.element_at(longs(hilbert_order(len(dims), bits).tolist()), cell + 1))
    placed = written(placed.drop(*names), "placed")
    cells = placed.groupBy("hilbert_").agg(F.count("*").alias("n_")).collect()
    total = sum(r["n_"] for r in cells)
    most = max(PART_ROWS, int(total * PART_SHARE))
    split = sorted((r["hilbert_"], -(-r["n_"] // most)) for r in cells if r["n_"] > most)  # fewer than 1 / PART_SHARE
    parts = F.lit(1).cast("long")
    if split:
        at = F.array_position(longs([h for h, _ in split]), F.col("hilbert_"))
        parts = F.when(at > 0, F.element_at(longs([k for _, k in split]), F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.lit(1))
    placed = placed.withColumn("part_", F.pmod(F.xxhash64("row_"), parts))
    runs = placed.groupBy("hilbert_", "part_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("hilbert_", "part_").rowsBetween(Window.unboundedPreceding, -1)  # at most 66,560 rows
    starts = runs.select("hilbert_", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = F.row_number().over(Window.partitionBy("hilbert_", "part_").orderBy(*[of(o) for o in order], "row_"))
    ranked = placed.withColumn("within_", within).join(F.broadcast(starts), ["hilbert_", "part_"])
    n = max(total, 1)
    ranked = ranked.withColumn("rank_", F.col("start_") + F.col("within_") - 1).withColumn("shard_", F.expr(f"CAST(rank_ * {shards} div {n} AS INT)"))
    ranked = ranked.withColumn("slot_", F.expr(f"rank_ - (shard_ * {n}L + {shards - 1}) div {shards}"))
    named = ranked.select(*plain.columns, "hilbert_", "shard_", "slot_").toDF(*df.columns, "hilbert_", "shard_", "slot_")
    return with_results(named, ["hilbert", "shard", "slot"], ["hilbert_", "shard_", "slot_"])


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """The range of every dimension in every shard, by which a reader skips shards."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))])


def write_shards(df: DataFrame, sharded: DataFrame, key: list[str], path: str) -> None:
    """The rows of ``df`` in a folder for each shard, in the order of their slots."""
    both = df.join(sharded.select(*key, "shard", "slot"), key)
    both.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The law is ``rows``: counts of shards differ by one at most."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    narrow = chosen(docs, "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", size.alias("size"), crc.alias("text_crc32"), F.log2(size).alias("_weight"))
    out = hilbert_shards(narrow, ["lang", "source", "_weight", "doc_id"], ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
