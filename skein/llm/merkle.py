"""A Merkle manifest of a table: a tree for each group, a tree over the groups' roots, and a proof for every row.

A row's place is its exact rank among its group by doc_id, found by digit histograms (``radix``), never by a global sort. The
ranks' digits to the base 3 are the keys of a trie: a node's children are the keys that it is the longest proper prefix of,
and a node without its first digit names its parent. Nodes are reduced by prefix, six digits at a time: the 729 nodes of one
prefix meet in one row, whose levels are built by array functions; the next stride has a 729th of the nodes. Paths come
back down in the same strides, so that a node's siblings reach its rows through as many joins as there are strides.

H is sha256 in lower-case hexadecimal digits, and digests are joined as such. A leaf is H of the columns' values, each "-" if
null, else its number of UTF-8 bytes, ":" and itself. Three consecutive nodes (the last run: fewer, even one) become their H,
until one is left. Group roots, ordered by group (null first, bytewise), likewise become the root.

Cases: a null doc_id comes before all others of its group. Rows of one doc_id are ordered by their leaves; equal rows have
equal leaves and a place each. A null group is a group. A group of one row has that row's leaf for its root, and so has a
table of one group. Other columns are ignored, whatever their names. An empty table has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.names import numbered
from skein.llm.radix import long_key, nulls_first, ranked
from skein.scratch import written

FANOUT = 3
#: Levels that are built in one row, and the nodes that meet there.
STRIDE = 6
BLOCK = FANOUT**STRIDE
#: What a leaf holds, in order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _up(level: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: _hash(F.slice(level, i * FANOUT + 1, FANOUT)))


def _levels(nodes: DataFrame) -> DataFrame:
    """(group, block, n, rows, l0 .. l6) of blocks of nodes (group, rank, n, digest, ...): the rows of a block in order and
    the digests of its levels. A block that is alone stops growing at one digest, any other has STRIDE levels."""
    others = [c for c in nodes.columns if c not in ("group", "rank", "n")]
    rows = nodes.select("group", F.floor(F.col("rank") / BLOCK).alias("block"), "n", F.struct("rank", *others).alias("row"))
    out = rows.groupBy("group", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("row")).alias("rows"))  # BLOCK rows at most
    out = out.withColumn("l0", F.transform("rows", lambda r: r["digest"]))
    for k in range(STRIDE):
        ended = (F.col("n") <= BLOCK) & (F.size(f"l{k}") == 1)
        out = out.withColumn(f"l{k + 1}", F.when(ended, F.col(f"l{k}")).otherwise(_up(F.col(f"l{k}"))))
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """The nodes of the next stride: (group, rank, n, digest)."""
    top = _levels(nodes).select("group", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.get(f"l{STRIDE}", F.lit(0)).alias("digest"))
    return written(top, "blocks")


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, their siblings on every level up to the root, of blocks' paths ``above`` (group, rank, path)."""
    blocks = _levels(nodes).join(above.select("group", F.col("rank").alias("block"), F.col("path").alias("above")), ["group", "block"])

    def siblings(at: Column) -> Column:
        steps = []
        for k in range(STRIDE):
            own = F.floor(at / FANOUT**k).cast("int")
            start, level = own - own % FANOUT, F.col(f"l{k}")
            beside = F.struct(F.array_join(F.slice(level, start + 1, own - start), "").alias("left"), F.array_join(F.slice(level, own + 2, FANOUT - 1 - (own - start)), "").alias("right"))
            # A lone node of a block that is alone is the group's root and has no level above it here.
            steps.append(F.when((F.col("n") > BLOCK) | (F.size(level) > 1), beside))
        return F.array_compact(F.array(*steps))

    each = F.transform("rows", lambda r, i: F.struct(r.alias("row"), F.concat(siblings(i), F.col("above")).alias("path")))
    out = blocks.select("group", "n", F.explode(each).alias("x"))
    return out.select("group", "n", "x.row.*", "x.path")


class Forest:
    """Trees over the groups of ``nodes`` (group, rank, n, digest, ...), at rest."""

    def __init__(self, nodes: DataFrame):
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.strides = [nodes]
        while most > 1:
            below = self.strides[-1] if len(self.strides) == 1 else self.strides[-1].filter("n > 1")
            self.strides.append(_blocks(below))
            most = -(-most // BLOCK)

    def roots(self) -> DataFrame:
        """(group, digest): a group is done on the first stride that leaves it one node."""
        if len(self.strides) == 1:
            return self.strides[0].select("group", "digest")
        return reduce(DataFrame.union, [s.filter("n = 1").select("group", "digest") for s in self.strides[1:]])

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes with their paths, which end with those of their groups, ``above`` (group, path)."""
        if len(self.strides) == 1:
            return self.strides[0].join(above, "group")
        known: DataFrame | None = None
        for below, stride in zip(self.strides[-2::-1], self.strides[:0:-1], strict=True):
            ended = stride.filter("n = 1").join(above, "group").select("group", "rank", "path")
            known = ended if known is None else ended.union(known)
            nodes = below if below is self.strides[0] else below.filter("n > 1")
            known = _with_paths(nodes, known)
            if below is not self.strides[0]:
                known = written(known.select("group", "rank", "path"), "paths")
        return known


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, rank, leaf, subroot, root, path of every row; ``path`` holds the siblings on the left and on the right
    on every level from the leaf to the root. ``carried``: further columns, of the columns of ``docs``."""
    docs, of = numbered(docs)
    group = nulls_first(F.hex(F.col(of(group_col)).cast("string").cast("binary")))
    extra = carried(of) if carried else {}
    rows = docs.select(F.col(of(id_col)).cast("long").alias("doc_id"), F.col(of(group_col)).cast("string").alias("source"), group.alias("group"), leaf([F.col(of(c)) for c in columns]).alias("digest"), F.monotonically_increasing_id().alias("row_"), *[c.alias(k) for k, c in extra.items()])
    rows = written(rows, "leaves").withColumn("key_", F.concat(nulls_first(long_key(F.col("doc_id"))), F.col("digest"), long_key(F.col("row_"))))
    leaves = written(ranked(rows, ["group"], "key_").drop("key_", "row_"), "ranked")
    forest = Forest(leaves)
    subroots = written(forest.roots().withColumnRenamed("group", "key_").withColumn("group", F.lit("")), "subroots")
    top = Forest(written(ranked(subroots, ["group"], "key_"), "ranked"))
    root = top.roots().select("group", F.col("digest").alias("root"))
    empty = root.select("group", F.array().cast(PATH).alias("path"))
    groups = top.paths(empty).join(root, "group").select(F.col("key_").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    groups = written(groups, "groups")
    out = forest.paths(groups.select("group", "path")).join(groups.select("group", "subroot", "root"), "group")
    return out.select("doc_id", "source", "rank", F.col("digest").alias("leaf"), "subroot", "root", "path", *extra)


def folded(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to along ``path``."""
    return F.aggregate(path, digest, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proofs_of_documents(docs: DataFrame) -> DataFrame:
    """The columns of the contract; every document whose doc_id has an even CRC loses the line breaks of its text."""

    def tampered(of) -> dict[str, Column]:
        even = F.crc32(F.col(of("doc_id")).cast("string").cast("binary")) % 2 == 0
        text = F.when(even, F.replace(F.col(of("text")), F.lit("\n"), F.lit(""))).otherwise(F.col(of("text")))
        return {"tampered": leaf([F.col(of(c)) if c != "text" else text for c in COLUMNS])}

    found = manifest(docs, carried=tampered)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _trees(name: str, leaves: str) -> str:
    """SQL of all nodes of the trees over ``leaves`` (g, r, n, h), and of each node's siblings."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, r, n, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM {name} WHERE n > 1 GROUP BY g, lvl, r // 3, n),
{name}_beside AS (
  SELECT a.g, a.lvl, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS r_
  FROM {name} a LEFT JOIN {name} b ON a.g = b.g AND a.lvl = b.lvl AND a.r // 3 = b.r // 3 AND a.r <> b.r WHERE a.n > 1 GROUP BY a.g, a.lvl, a.r)"""


def _oracle() -> str:
    def field(x: str) -> str:
        return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    fields = " || ".join(field(c) for c in COLUMNS[:-1])
    byte = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, x: {byte}), 4294967295)"
    return f"""
WITH RECURSIVE
d AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text2 FROM documents),
hashed AS (SELECT doc_id, source, sha256({fields} || {field("text")}) AS h, sha256({fields} || {field("text2")}) AS h2 FROM d),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS g, count(*) AS n FROM documents GROUP BY source),
leaves AS (
  SELECT doc_id, g, n, h, h2, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r
  FROM hashed JOIN groups ON hashed.source IS NOT DISTINCT FROM groups.source),
{_trees("t", "leaves")},
subroots AS (SELECT g AS own, 0 AS g, g - 1 AS r, (SELECT count(*) FROM groups) AS n, h FROM t WHERE n = 1),
{_trees("u", "subroots")},
root AS (SELECT h FROM u WHERE n = 1),
heights AS (SELECT g, max(lvl) AS k FROM t GROUP BY g),
path AS (
  SELECT doc_id, l.g, l.r, b.lvl, b.l, b.r_ FROM leaves l JOIN t_beside b ON l.g = b.g AND l.r // CAST(pow(3, b.lvl) AS BIGINT) = b.r
  UNION ALL
  SELECT doc_id, l.g, l.r, k + b.lvl, b.l, b.r_ FROM leaves l JOIN heights ON heights.g = l.g JOIN u_beside b ON (l.g - 1) // CAST(pow(3, b.lvl) AS BIGINT) = b.r),
proofs AS (SELECT g, r, sha256(string_agg(l || r_, '' ORDER BY lvl)) AS p FROM path GROUP BY g, r),
fold AS (
  SELECT g, r, 0 AS lvl, h2 AS h FROM leaves
  UNION ALL
  SELECT fold.g, fold.r, fold.lvl + 1, sha256(path.l || fold.h || path.r_) FROM fold JOIN path ON path.g = fold.g AND path.r = fold.r AND path.lvl = fold.lvl),
ended AS (SELECT g, r, arg_max(h, lvl) AS h FROM fold GROUP BY g, r)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM leaves l JOIN subroots s ON s.own = l.g JOIN ended e ON e.g = l.g AND e.r = l.r LEFT JOIN proofs p ON p.g = l.g AND p.r = l.r, root
"""


ORACLE = _oracle()
