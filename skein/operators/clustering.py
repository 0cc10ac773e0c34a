"""Correlation: buckets, bounded linking through artifacts, anchored windows, sessions and longitudinal candidates.

The result is a table of memberships (cluster_id, event_key, ord); an observation may belong to several clusters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import connected
from skein.operators.ordered import counted, runs
from skein.scratch import written

MAX_LINKED_BUCKETS = 50
MICROS_PER_HOUR = 3_600_000_000
#: Rows of a segment whose windows one task finds by a walk; of a larger one they are found by doubling.
SEGMENT_ROWS = 20_000
#: What memberships read of the features.
READS = ["event_key", "us", "ingest_ord", "bucket", "actor_key", "platform", "resource_key", "artifacts", "all_credentials", "any_opaque", "scaffold"]
#: Edges of an oversized component that one task walks; more of them are settled in rounds first.
WALKED_EDGES = 50_000


def digest(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def link_edges(features: DataFrame) -> DataFrame:
    """(kind, value, a, b): an artifact's first bucket and each other bucket it links it to."""
    uses = features.select("bucket", "actor_key", "platform", "resource_key", F.explode("artifacts").alias("x"))
    uses = uses.filter(F.col("x.kind").startswith("marker:") | (F.col("x.kind") == "code"))
    scope = uses.groupBy("x.kind", "x.value").agg(
        F.count_distinct("bucket").alias("buckets"),
        F.count_distinct("actor_key").alias("actors"),
        F.count_distinct("platform").alias("platforms"),
        F.count_distinct("resource_key").alias("resources"),
    )
    good = scope.filter("buckets BETWEEN 2 AND 10 AND actors >= 2 AND (platforms >= 2 OR resources >= 2)").select("kind", "value")
    held = uses.select("x.kind", "x.value", "bucket").distinct().join(good, ["kind", "value"])
    keys = held.groupBy("kind", "value").agg(F.array_sort(F.collect_set("bucket")).alias("keys"))  # at most 10
    return keys.select("kind", "value", F.get("keys", F.lit(0)).alias("a"), F.explode(F.slice("keys", 2, 10)).alias("b"))


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """Unions of what is left of one oversized component, edge by edge; one that would pass the cap is left out."""
    parent: dict[str, str] = {}
    size: dict[str, int] = dict(zip(rows["x"], rows["sx"], strict=True)) | dict(zip(rows["y"], rows["sy"], strict=True))

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows.sort_values(["kind", "value", "b"])[["x", "y"]].itertuples(index=False):
        x, y = root(a), root(b)
        if x != y and size[x] + size[y] <= MAX_LINKED_BUCKETS:
            parent[y] = x
            size[x] += size[y]
    return pd.DataFrame([(k, root(k)) for k in parent], columns=["at", "to"])


def _capped(edges: DataFrame) -> DataFrame:
    """(bucket, component) of oversized components, whose edges (component, kind, value, a, b) count in the order of (kind,
    value, b), one that would pass the cap being left out.

    An edge that comes first at both its ends is decided: no edge before it can change either. All such edges are taken at
    once, which merges ends in pairs; edges that the cap rules out already, or whose ends have met, go. What is left of a
    component is walked in one task once it has few edges.
    """
    buckets = edges.select(F.col("a").alias("bucket")).union(edges.select("b")).distinct()
    labels = written(buckets.withColumn("at", F.col("bucket")), "labels")
    order, one = F.struct("kind", "value", "b").alias("r"), F.lit(1)
    pending = edges.select("component", order, F.col("a").alias("x"), F.col("b").alias("y"), one.alias("sx"), one.alias("sy"))
    while True:
        open_ = pending.filter((F.col("x") != F.col("y")) & (F.col("sx") + F.col("sy") <= MAX_LINKED_BUCKETS))
        turned = F.col("x") > F.col("y")
        pair = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("x", "y"), ("y", "x"), ("sx", "sy"), ("sy", "sx"))]
        # Of several edges between two ends only the first can be taken.
        pending = written(open_.select("component", "r", *pair).groupBy("component", "x", "y").agg(F.min("r").alias("r"), F.first("sx").alias("sx"), F.first("sy").alias("sy")), "pending")
        if pending.groupBy("component").count().filter(F.col("count") > WALKED_EDGES).isEmpty():
            break
        first = pending.select(F.col("x").alias("c"), "r").union(pending.select("y", "r")).groupBy("c").agg(F.min("r").alias("first"))
        at_x, at_y = (first.select(F.col("c").alias(k), F.col("first").alias(f"first_{k}")) for k in ("x", "y"))
        taken = pending.join(at_x, "x").join(at_y, "y").filter("r = first_x AND r = first_y").select("x", "y", (F.col("sx") + F.col("sy")).alias("size"))
        moved = written(taken.select(F.col("y").alias("c"), F.col("x").alias("to"), "size").union(taken.select("x", "x", "size")), "moved")
        for end in ("x", "y"):
            new = moved.select(F.col("c").alias(end), F.col("to").alias("to_"), F.col("size").alias("size_"))
            pending = pending.join(new, end, "left").withColumns({end: F.coalesce("to_", end), f"s{end}": F.coalesce("size_", f"s{end}")}).drop("to_", "size_")
        labels = written(labels.join(moved.select(F.col("c").alias("at"), "to"), "at", "left").select("bucket", F.coalesce("to", "at").alias("at")), "labels")
    rest = pending.select("component", "r.*", "x", "y", "sx", "sy").groupBy("component").applyInPandas(lambda rows: _settled(rows), "at string, to string")
    return labels.join(rest, "at", "left").select("bucket", F.coalesce("to", "at").alias("component"))


def linked_buckets(features: DataFrame) -> DataFrame:
    """(bucket, cluster_key) for buckets that artifacts link. Of at most 50 buckets each.

    A component within the cap needs no order. A larger one is built edge by edge in the order of (kind, value, bucket).
    """
    edges = written(link_edges(features), "links")
    labels = connected(edges.select("a", "b"))
    whole = labels.select(F.col("v").alias("bucket"), F.col("c").alias("component"))
    whole = whole.union(whole.select("component", "component").distinct())
    sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
    small = whole.join(sizes.filter(F.col("n") <= MAX_LINKED_BUCKETS), "component").select("bucket", "component")
    large = sizes.filter(F.col("n") > MAX_LINKED_BUCKETS).select("component")
    inside = edges.join(whole, edges["a"] == whole["bucket"]).join(large, "component").select("component", "kind", "value", "a", "b")
    members = small if large.isEmpty() else small.union(_capped(inside))
    named = members.groupBy("component").agg(F.array_sort(F.collect_set("bucket")).alias("keys")).filter(F.size("keys") > 1)
    named = named.select(F.concat(F.lit("linked:"), digest(F.array_join("keys", "\n"), 20)).alias("cluster_key"), "keys")
    return named.select(F.explode("keys").alias("bucket"), "cluster_key")


def _walked(segments: DataFrame, size: int) -> DataFrame:
    """(key, segment, us) of the rows that open a window, of segments of SEGMENT_ROWS times at most."""
    opened = F.aggregate(
        F.array_sort(F.collect_set("us")),
        F.struct(F.min("us").alias("at"), F.array(F.min("us")).alias("all")),
        lambda a, us: F.when(us - a["at"] > size, F.struct(us.alias("at"), F.array_append(a["all"], us).alias("all"))).otherwise(a),
        lambda a: a["all"],
    )
    return segments.groupBy("key", "segment").agg(opened.alias("all")).select("key", "segment", F.explode("all").alias("us"))


def _jumps(rows: DataFrame, size: int) -> DataFrame:
    """(key, segment, us, next) of distinct times: the next opener, if the row opens a window.

    A window's length makes a part, so that the next opener lies in the part after the row's own or, if none there is late
    enough, is the first row of a later part. Each part is merged with the times at which windows of the part before end.
    """
    by = ["key", "segment"]
    rows = rows.select(*by, "us").distinct().withColumn("part", F.floor(F.col("us") / size))
    over = Window.partitionBy(*by).orderBy("part")
    firsts = rows.groupBy(*by, "part").agg(F.min("us").alias("us"))
    far = F.when(F.lead("part").over(over) > F.col("part") + 1, F.lead("us").over(over)).otherwise(F.lead("us", 2).over(over))
    ends = rows.join(firsts.select(*by, "part", far.alias("far")), [*by, "part"]).select(*by, (F.col("part") + 1).alias("part"), (F.col("us") + size).alias("at"), F.lit(0).alias("kind"), "us", "far")
    none = F.lit(None).cast("long")
    both = ends.union(rows.select(*by, "part", F.col("us").alias("at"), F.lit(1).alias("kind"), none, none))
    # From the last time to the first: the time met last before a window's end is the first after it.
    after = F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(Window.partitionBy(*by, "part").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("near", after).filter("kind = 0").select(*by, "us", F.coalesce("near", "far").alias("next")).filter("next IS NOT NULL")


def _jumped(rows: DataFrame, size: int) -> DataFrame:
    """(key, segment, us) of the rows that open a window, by doubling: after n rounds the first 2^n of each segment are known."""
    by = ["key", "segment"]
    jumps = written(_jumps(rows, size), "jumps")
    openers = written(rows.groupBy(*by).agg(F.min("us").alias("us")), "openers")
    while True:
        more = written(openers.join(jumps, [*by, "us"]).select(*by, F.col("next").alias("us")), "openers")
        if more.isEmpty():
            return openers
        openers = openers.union(more)
        onward = jumps.select(*by, F.col("us").alias("next"), F.col("next").alias("then"))
        jumps = written(jumps.join(onward, [*by, "next"]).select(*by, "us", F.col("then").alias("next")), "jumps")


def anchored_windows(rows: DataFrame, key: str, minutes: int = 60) -> DataFrame:
    """``rows`` (with us and ingest_ord) and their ``window``: a row opens a new one if it lies more than ``minutes`` after
    the row that opened the last (inclusive bound).

    A row that lies so far after the row before it opens a window in any case, which cuts a key into segments. A segment no
    longer than a window is one; the openers of one with few rows are found by one walk over its times, those of a larger
    one by doubling jumps from opener to opener, which is the work of as many tasks as its rows need.
    """
    size = minutes * 60_000_000
    order = ["us", "ingest_ord"]
    own = F.col(key)
    narrow = rows.select(F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), own)).alias("key"), "us", "ingest_ord", "event_key")
    cut = written(runs(narrow, ["key"], order, size, "segment"), "segments")
    sizes = written(cut.groupBy("key", "segment").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last")), "sizes")
    long = sizes.filter(F.col("last") - F.col("first") > size)
    openers = sizes.filter(F.col("last") - F.col("first") <= size).select("key", "segment", F.col("first").alias("us"))
    for few, found in ((True, _walked), (False, _jumped)):
        own = long.filter((F.col("n") <= SEGMENT_ROWS) if few else (F.col("n") > SEGMENT_ROWS)).select("key", "segment")
        if not own.isEmpty():
            openers = openers.unionByName(found(cut.select("key", "segment", "us").join(own, ["key", "segment"], "left_semi"), size))
    marked = cut.join(openers.select("key", "us", F.lit(True).alias("opens")), ["key", "us"], "left")
    # Of rows at an opener's time the first opens the window.
    first = F.row_number().over(Window.partitionBy("key", "us").orderBy("ingest_ord")) == 1
    flagged = marked.withColumn("window", (F.col("opens").isNotNull() & first).cast("int"))
    # It counts before all others of its time, in whatever order they come.
    out = counted(flagged.select("key", *order, "event_key", "window"), ["key"], ["us", F.desc("window")], "window")
    return out.select(F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("key"), *order, "event_key", (F.col("window") - 1).alias("window"))


def window_clusters(features: DataFrame, minutes: int = 60) -> DataFrame:
    """cluster_id, event_key of the anchored windows of (linked) buckets."""
    links = linked_buckets(features)
    keyed = features.select("bucket", "event_key", "us", "ingest_ord").join(links, "bucket", "left")
    keyed = keyed.withColumn("cluster_key", F.coalesce("cluster_key", "bucket"))
    # Buckets of a linked cluster follow each other in name order before the stable sort by time.
    order = F.struct("bucket", "ingest_ord")
    found = anchored_windows(keyed.withColumn("ingest_ord", order), "cluster_key", minutes)
    return found.select(F.concat("key", F.lit(":"), "window").alias("cluster_id"), "event_key")


def sessions(rows: DataFrame, by: list[str], hours: int = 2) -> DataFrame:
    """``rows`` with ``session`` (from 0): a new one starts after a gap of more than ``hours``."""
    return runs(rows, by, ["us", "ingest_ord"], hours * MICROS_PER_HOUR, "session")


def _none_counts(c: str) -> Column:
    """Distinct values where an absent one counts as a value."""
    return F.count_distinct(F.coalesce(c, F.lit("\0")))


def longitudinal(features: DataFrame) -> DataFrame:
    """(kind_ord, cluster_id, event_key) of long trajectories of an actor, resource, credential or opaque scaffold."""
    span = (F.max("us") - F.min("us")) >= 36 * MICROS_PER_HOUR
    f = features.select("event_key", "actor_key", "resource_key", "us", "ingest_ord", "all_credentials", "any_opaque", "scaffold")
    actors = f.groupBy("actor_key").agg(span.alias("long"), F.count("*").alias("n"), _none_counts("resource_key").alias("r")).filter("long AND n >= 10 AND r >= 2").select("actor_key")
    resources = f.filter("resource_key IS NOT NULL").groupBy("resource_key").agg(span.alias("long"), F.count("*").alias("n"), F.count_distinct("actor_key").alias("a")).filter("long AND n >= 16 AND a >= 2").select("resource_key")
    uses = f.withColumn("credential", F.explode("all_credentials"))
    shared = uses.groupBy("credential").agg(F.count("*").alias("n"), F.count_distinct("actor_key").alias("a"), _none_counts("resource_key").alias("r")).filter("n >= 4 AND a >= 2 AND r >= 2").select("credential")
    opaque = sessions(f.filter("any_opaque AND length(scaffold) >= 8"), ["scaffold"])
    runs = opaque.groupBy("scaffold", "session").agg(F.count("*").alias("n"), F.count_distinct("actor_key").alias("a"), F.array_join(F.array_sort(F.collect_list("event_key")), "\n").alias("keys")).filter("n >= 6 AND a >= 2")
    runs = runs.select("scaffold", "session", F.concat(F.lit("trajectory:opaque:"), digest(F.col("scaffold"), 10), F.lit(":"), "session", F.lit(":"), digest(F.col("keys"), 12)).alias("cluster_id"))

    def named(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"trajectory:{kind}:"), digest(F.col(key), 16))

    return (
        f.join(actors, "actor_key").select(F.lit(1).alias("kind_ord"), named("actor", "actor_key").alias("cluster_id"), "event_key")
        .union(f.join(resources, "resource_key").select(F.lit(2), named("resource", "resource_key"), "event_key"))
        .union(uses.join(shared, "credential").select(F.lit(3), named("credential", "credential"), "event_key"))
        .union(opaque.join(runs, ["scaffold", "session"]).select(F.lit(4), "cluster_id", "event_key"))
    )


def fingerprints(memberships: DataFrame) -> DataFrame:
    """(cluster_id, fingerprint) of the sorted event keys. Two clusters of the same events share it."""
    n = F.count("*").alias("n")
    # Order-free sums of digests instead of one sorted list, so that a large cluster needs no large buffer.
    h = [F.sum(F.conv(F.substring(F.sha2("event_key", 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    return memberships.groupBy("cluster_id").agg(n, *h).select("cluster_id", F.sha2(F.concat_ws(":", "n", "h0", "h1", "h2", "h3"), 256).alias("fingerprint"))


def memberships(features: DataFrame, minutes: int = 60) -> DataFrame:
    """cluster_id, event_key of windows and of those trajectories that no earlier cluster equals."""
    windows = window_clusters(features, minutes)
    long = longitudinal(features)
    both = windows.select(F.lit(0).alias("kind_ord"), "*").union(long)
    both = written(both, "members")
    prints = fingerprints(both).join(both.select("cluster_id", "kind_ord").distinct(), "cluster_id")
    first = prints.groupBy("fingerprint").agg(F.min(F.struct("kind_ord", "cluster_id")).alias("m"))
    kept = prints.join(first, "fingerprint").filter("kind_ord = 0 OR cluster_id = m.cluster_id").select("cluster_id")
    return both.select("cluster_id", "event_key").join(kept, "cluster_id", "left_semi")
