"""The largest strongly connected component of every cluster's graph.

A cluster with few edges is walked in one task. The graphs of all others are reduced together, in tables:

  * a vertex without an edge in or out is in no cycle and goes;
  * an edge that is its source's only one out and its target's only one in joins the two, since whatever cycle runs through
    one runs through the other. Such chains are contracted at once, as connected components, so that a long cycle or path
    takes as many rounds as the logarithm of its length; a chain that is closed is a component of its own;
  * where neither is left for the first time, the component of each cluster's busiest vertex, most often the largest by far,
    is what this vertex reaches and is reached from, and goes;
  * where neither is left again, colours run forward along the edges, each vertex keeping the greatest that reaches it; what
    reaches a colour's own vertex back within its colour is a component, and goes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected
from skein.scratch import written

#: Edges of a cluster that one task walks, as numbers (some hundred bytes an edge at most, their names included).
WALKED_EDGES = 1_000_000


def _neighbours(a: np.ndarray, b: np.ndarray, n: int) -> Callable[[int], list[int]]:
    """From a number to the numbers that its edges (a, b) lead to."""
    order = np.argsort(a, kind="stable")
    to, starts = b[order], np.searchsorted(a[order], np.arange(n + 1)).tolist()
    return lambda v: to[starts[v] : starts[v + 1]].tolist()


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """Size of the largest component of one cluster, by two walks, ahead and back."""
    codes, names = pd.factorize(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]))
    src, dst, n = codes[: len(rows)], codes[len(rows) :], len(names)
    ahead, back = _neighbours(src, dst, n), _neighbours(dst, src, n)
    finished, seen = [], bytearray(n)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = 1
        stack = [(root, iter(ahead(root)))]
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if not seen[nxt]:
                    seen[nxt] = 1
                    stack.append((nxt, iter(ahead(nxt))))
                    break
            else:
                finished.append(node)
                stack.pop()
    largest, placed = 1, bytearray(n)
    for root in reversed(finished):
        if placed[root]:
            continue
        placed[root] = 1
        stack, size = [root], 0
        while stack:
            size += 1
            for nxt in back(stack.pop()):
                if not placed[nxt]:
                    placed[nxt] = 1
                    stack.append(nxt)
        largest = max(largest, size)
    return pd.DataFrame([(rows["cluster_id"].iloc[0], largest)], columns=["cluster_id", "scc"])


class _Reduction:
    """Edges (a, b) between vertices (cluster_id, v, w), ``w`` counting the vertices that one stands for; ``found`` gathers
    (cluster_id, scc) of components, or of parts of them."""

    def __init__(self, edges: DataFrame):
        # A cluster's vertices are its own.
        ends = [F.concat(F.length("cluster_id").cast("string"), F.lit(":"), "cluster_id", F.lit(":"), end) for end in ("src", "dst")]
        own = edges.select("cluster_id", ends[0].alias("a"), ends[1].alias("b"))
        self.edges = written(own.select("a", "b").distinct(), "arcs")
        self.vertices = written(own.select("cluster_id", F.col("a").alias("v")).union(own.select("cluster_id", "b")).distinct().withColumn("w", F.lit(1).cast("long")), "vertices")
        self.found: list[DataFrame] = []

    def _note(self, groups: DataFrame) -> None:
        """``groups`` (v, r): each r's vertices are strongly connected."""
        sizes = groups.join(self.vertices, "v").groupBy("cluster_id", "r").agg(F.sum("w").alias("scc"))
        self.found.append(written(sizes.select("cluster_id", "scc"), "found"))

    def trimmed(self) -> bool:
        n = self.edges.count()
        into, out = self.edges.select(F.col("b").alias("a")).distinct(), self.edges.select(F.col("a").alias("b")).distinct()
        self.edges = written(self.edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b"), "arcs")
        return self.edges.count() < n

    def contracted(self) -> bool:
        one_out = self.edges.groupBy("a").agg(F.count("*").alias("n")).filter("n = 1").select("a")
        one_in = self.edges.groupBy("b").agg(F.count("*").alias("n")).filter("n = 1").select("b")
        chains = written(self.edges.join(one_out, "a", "left_semi").join(one_in, "b", "left_semi").select("a", "b"), "chains")
        if chains.isEmpty():
            return False
        labels = connected(chains).select("v", F.col("c").alias("r"))
        labels = written(labels.union(labels.select("r", "r").distinct()), "labels")
        links = chains.join(labels.withColumnRenamed("v", "a"), "a").groupBy("r").agg(F.count("*").alias("links"))
        closed = labels.groupBy("r").agg(F.count("*").alias("n")).join(links, "r").filter("links = n").select("r")
        self._note(labels.join(closed, "r", "left_semi"))
        rest = self.edges.join(chains, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(labels.select(F.col("v").alias(end), F.col("r").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        merged = self.vertices.join(labels, "v", "left").groupBy("cluster_id", F.coalesce("r", "v").alias("v")).agg(F.sum("w").alias("w"))
        self.vertices, rest = written(merged, "vertices"), written(rest.distinct(), "arcs")
        # An edge within one is a cycle through all that it stands for.
        self._note(rest.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("r")))
        self.edges = rest.filter("a <> b")
        return True

    def _reached(self, seeds: DataFrame, source: str, target: str) -> DataFrame:
        """(v) of what edges lead to from ``seeds`` (v), these included."""
        reached = front = seeds
        while not front.isEmpty():
            onward = self.edges.join(front.select(F.col("v").alias(source)), source, "left_semi").select(F.col(target).alias("v")).distinct()
            front = written(onward.join(reached, "v", "left_anti"), "front")
            reached = reached.union(front)
        return written(reached, "reached")

    def centred(self) -> None:
        out = self.edges.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("out"))
        into = self.edges.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("into"))
        busiest = out.join(into, "v").join(self.vertices, "v").groupBy("cluster_id").agg(F.max(F.struct(F.col("out") * F.col("into"), "v")).alias("m"))
        seeds = written(busiest.select("cluster_id", "m.v"), "seeds")
        both = self._reached(seeds.select("v"), "a", "b").join(self._reached(seeds.select("v"), "b", "a"), "v", "left_semi")
        both = written(both.join(self.vertices, "v").select("v", F.col("cluster_id").alias("r")), "centre")
        self._note(both)
        for end in ("a", "b"):
            self.edges = self.edges.join(both.select(F.col("v").alias(end)), end, "left_anti")
        self.edges = written(self.edges.select("a", "b"), "arcs")

    def coloured(self) -> None:
        vertices = self.edges.select(F.col("a").alias("v")).union(self.edges.select("b")).distinct()
        colours = written(vertices.withColumn("k", F.col("v")), "colours")
        while True:
            sent = self.edges.join(colours.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.max("k").alias("sent"))
            grown = written(colours.join(sent, "v", "left").select("v", F.greatest("k", F.coalesce("sent", "k")).alias("k"), (F.col("sent") > F.col("k")).alias("new")), "colours")
            colours = grown.select("v", "k")
            if grown.filter("new").isEmpty():
                break
        inside = self.edges.join(colours.select(F.col("v").alias("a"), "k"), "a").join(colours.select(F.col("v").alias("b"), F.col("k").alias("kb")), "b").filter("k = kb")
        inside = written(inside.select("a", "b", "k"), "inside")
        reached = written(colours.filter("v = k").select("v", "k"), "reached")
        front = reached
        while not front.isEmpty():
            front = written(inside.join(front.select(F.col("v").alias("b")), "b", "left_semi").select(F.col("a").alias("v"), "k").distinct().join(reached, "v", "left_anti"), "front")
            reached = reached.union(front)
        reached = written(reached, "reached")
        several = reached.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
        self._note(reached.join(several, "k", "left_semi").select("v", F.col("k").alias("r")))
        gone = reached.select("v")
        self.edges = written(inside.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"), "arcs")


def largest(edges: DataFrame) -> DataFrame:
    """(cluster_id, scc) for every cluster of ``edges`` (cluster_id, src, dst; at rest, without loops)."""
    sizes = written(edges.groupBy("cluster_id").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > WALKED_EDGES).select("cluster_id")
    small = edges.select("cluster_id", "src", "dst")
    if large.isEmpty():
        return small.groupBy("cluster_id").applyInPandas(_walked, "cluster_id string, scc long")
    left = _Reduction(edges.join(large, "cluster_id", "left_semi"))
    centred = False
    while not left.edges.isEmpty():
        shrunk = left.trimmed()
        if not left.contracted() and not shrunk:
            left.coloured() if centred else left.centred()
            centred = True
    most = large.withColumn("scc", F.lit(1).cast("long"))
    for sizes in left.found:
        most = most.union(sizes)
    most = most.groupBy("cluster_id").agg(F.max("scc").alias("scc"))
    return most.union(small.join(large, "cluster_id", "left_anti").groupBy("cluster_id").applyInPandas(_walked, "cluster_id string, scc long"))
