"""Detectors: functions of the clustered observations (features and cluster_id, one row a membership) to signals.

Each is a DataFrame branch of its own; ``REGISTRY`` names them in the order in which their signals count as emitted.
Ties of time keep input order (``ingest_ord``). Limits on references, paths and depth are part of the semantics.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.cycles import largest
from skein.operators.ordered import previous
from skein.operators.selection import medians
from skein.scratch import written

MAX_REFERENCE_OCCURRENCES, MAX_PATHS, MAX_REPLY_DEPTH = 100, 500, 16
#: Rows of a cluster whose median of gaps one buffer holds.
MEDIAN_ROWS = 1_000_000
MICROS = 1_000_000
HOUR = 3600 * MICROS
_TIME = ["us", "ingest_ord"]
#: Kinds of exchange: the act that opens a path and the act that ends it.
_KINDS = [("delegate_result", "delegation", "result"), ("checkpoint_resume", "state_out", "state_in")]


def _ordered():
    return Window.partitionBy("cluster_id").orderBy(*_TIME)


def _strings(*items) -> Column:
    return F.array(*items) if items else F.array().cast("array<string>")


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _signal(df: DataFrame, family: str, name: str, score: Column, ord_: int, *, signal_ord=0, ids=None, evidence=None, groups=None, depends=None, longitudinal=None, cross=None, exceptional=None, native=None, cross_context=None) -> DataFrame:
    nothing = F.array().cast("array<string>")
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit(False))
    number = lambda c: F.lit(0) if c is None else c.cast("int")
    return df.select(
        "cluster_id",
        F.lit(family).alias("family"),
        F.lit(name).alias("name"),
        score.cast("double").alias("score"),
        F.lit(ord_).alias("detector_ord"),
        (F.lit(signal_ord) if isinstance(signal_ord, int) else signal_ord).cast("long").alias("signal_ord"),
        (nothing if ids is None else ids).alias("observation_ids"),
        (nothing if evidence is None else evidence).alias("evidence"),
        (nothing if groups is None else groups).alias("evidence_groups"),
        (nothing if depends is None else depends).alias("depends_on"),
        flag(longitudinal).alias("longitudinal"),
        flag(cross).alias("cross_resource"),
        flag(exceptional).alias("exceptional"),
        number(native).alias("verified_native"),
        number(cross_context).alias("verified_cross"),
    )


def _keys_in_order() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("us", "ingest_ord", "event_key"))), lambda x: x["event_key"])


def _all(c: str) -> Column:
    """Distinct values, an absent one counting as a value."""
    return F.count_distinct(F.coalesce(c, F.lit("\0")))


def protocol(c: DataFrame) -> DataFrame:
    hit = c.filter(F.size("protocol") > 0)
    return _signal(hit, "protocol", "protocol_markers", F.least(F.lit(1.0), 0.15 + 0.14 * F.size("protocol")), 1, signal_ord=F.row_number().over(_ordered()), ids=_strings(F.col("event_key")), evidence=F.col("protocol"))


def _strongest_protocol(c: DataFrame) -> DataFrame:
    """Of a cluster's signals of ``protocol`` one of the highest; they differ in nothing else that a scorer reads."""
    most = c.groupBy("cluster_id").agg(F.max(F.size("protocol")).alias("most")).filter("most > 0")
    return _signal(most, "protocol", "protocol_markers", F.least(F.lit(1.0), 0.15 + 0.14 * F.col("most")), 1)


def isolated_acts(c: DataFrame) -> DataFrame:
    """Weak acts of single messages, for diagnosis; not part of the registry."""
    hit = c.filter(F.size("acts") > 0)
    return _signal(hit, "semantic", "isolated_coordination_speech_act", F.least(F.lit(0.34), 0.18 + 0.05 * F.size("acts")), 0, ids=_strings(F.col("event_key")), evidence=F.col("acts"))


def ancestors(c: DataFrame) -> DataFrame:
    """(cluster_id, event_key, ancestors): replied-to events within the cluster, at most 16 up, cycles cut.

    Each round joins a path to the path of its top, so that four rounds reach 16 levels.
    """
    # Tables at rest are far larger than their files, by which Spark would send them to all tasks: keys are joined by merges.
    here = c.select("cluster_id", F.col("event_key").alias("parent_key")).hint("merge")
    edges = c.filter("parent_key IS NOT NULL").select("cluster_id", "event_key", "parent_key").join(here, ["cluster_id", "parent_key"])
    paths = written(edges.select("cluster_id", "event_key", F.array("parent_key").alias("ancestors")), "ancestry")
    reach = 1
    while reach < MAX_REPLY_DEPTH:
        onward = paths.select("cluster_id", F.col("event_key").alias("top"), F.col("ancestors").alias("rest")).hint("merge")
        joined = paths.withColumn("top", F.element_at("ancestors", -1)).join(onward, ["cluster_id", "top"], "left")
        # A chain that comes round to itself only repeats what it has.
        whole = F.array_distinct(F.concat("ancestors", F.coalesce("rest", F.array().cast("array<string>"))))
        reach *= 2
        paths = written(joined.select("cluster_id", "event_key", F.slice(whole, 1, MAX_REPLY_DEPTH).alias("ancestors")), "ancestry")
        if paths.filter(F.size("ancestors") >= reach).isEmpty():
            break
    return paths


def _with_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    return rows.join(lines.hint("merge"), ["cluster_id", "event_key"], "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))


def _first_right(right: DataFrame, lefts: DataFrame, most: int) -> DataFrame:
    """Of ``right`` rows, in their order, those that may be among a cluster's first ``most`` paths: fewer begin before them.

    Only paths through the one reference that gives a row most of them are counted, against ``lefts`` (cluster_id, ref, us,
    actor_raw), of which a reference has few; so no pair is written down.
    """
    sides = lefts.groupBy("cluster_id", "ref").agg(F.collect_list(F.struct("us", "actor_raw")).alias("lefts"))
    uses = right.select("cluster_id", "event_key", "us", "ingest_ord", "actor_raw", F.explode("refs").alias("ref")).join(sides, ["cluster_id", "ref"])
    n = F.size(F.filter("lefts", lambda x: (x["us"] <= F.col("us")) & (x["actor_raw"] != F.col("actor_raw"))))
    per = uses.select("cluster_id", "event_key", *_TIME, n.alias("n")).groupBy("cluster_id", "event_key", *_TIME).agg(F.max("n").alias("n"))
    before = F.sum("n").over(_ordered().rowsBetween(Window.unboundedPreceding, -1))
    late = per.withColumn("before", before).filter(F.col("before") >= most).select("cluster_id", "event_key")
    return right.join(late, ["cluster_id", "event_key"], "left_anti")


def exchange(c: DataFrame, occurrences: int | None = MAX_REFERENCE_OCCURRENCES, most: int | None = MAX_PATHS) -> DataFrame:
    """Linked delegation-result and checkpoint-resume trajectories across actors, with acknowledgements.

    Of a reference the first ``occurrences`` rows of a cluster are looked up, and ``most`` paths of a cluster count; None
    stands for all.
    """
    acting = c.filter((F.size("acts") > 0) | (F.size("refs") > 0))
    lines = ancestors(c.select("cluster_id", "event_key", "parent_key"))
    c = written(_with_lines(acting.select("cluster_id", "event_key", "us", "ingest_ord", "actor_raw", "acts", "refs", _context().alias("context")), lines), "acting")
    index = c.withColumn("ref", F.explode("refs"))
    if occurrences is not None:
        by_ref = Window.partitionBy("cluster_id", "ref").orderBy(*_TIME)
        index = index.withColumn("_n", F.row_number().over(by_ref)).filter(F.col("_n") <= occurrences)
    index = index.select("cluster_id", "ref", F.col("event_key").alias("left_key"), "acts", "us", "actor_raw")
    found = None
    for kind_ord, (kind, left_act, right_act) in enumerate(_KINDS):
        right = c.filter(F.array_contains("acts", right_act))
        if occurrences is not None and most is not None:
            right = written(_first_right(right, index.filter(F.array_contains("acts", left_act)), most).select("cluster_id", "event_key", "refs", "ancestors"), "right")
        native = right.select("cluster_id", F.col("event_key").alias("right_key"), F.explode("ancestors").alias("left_key"))
        shared = right.select("cluster_id", F.col("event_key").alias("right_key"), F.explode("refs").alias("ref")).join(index.filter(F.array_contains("acts", left_act)).select("cluster_id", "ref", "left_key"), ["cluster_id", "ref"]).select("cluster_id", "right_key", "left_key")
        pairs = native.union(shared).distinct().withColumns({"kind": F.lit(kind), "kind_ord": F.lit(kind_ord), "left_act": F.lit(left_act)})
        found = pairs if found is None else found.union(pairs)
    cols = ["us", "ingest_ord", "actor_raw", "refs", "ancestors", "context", "acts"]
    left = c.select("cluster_id", F.col("event_key").alias("left_key"), *[F.col(x).alias(f"l_{x}") for x in cols])
    right = c.select("cluster_id", F.col("event_key").alias("right_key"), *[F.col(x).alias(f"r_{x}") for x in cols])
    paths = found.join(left, ["cluster_id", "left_key"]).join(right, ["cluster_id", "right_key"])
    paths = paths.filter("array_contains(l_acts, left_act) AND l_us <= r_us AND l_actor_raw <> r_actor_raw")
    paths = paths.withColumns({"native": F.array_contains("r_ancestors", F.col("left_key")), "shared": F.array_intersect("l_refs", "r_refs")}).filter("native OR size(shared) > 0")
    if most is None:
        paths = paths.withColumn("path_no", F.monotonically_increasing_id())
    else:
        order = Window.partitionBy("cluster_id").orderBy("kind_ord", "r_us", "r_ingest_ord", "left_key")
        paths = paths.withColumn("path_no", F.row_number().over(order)).filter(F.col("path_no") <= most)
    paths = written(paths.select("cluster_id", "path_no", "kind", "left_key", "right_key", "native", "shared", "l_us", "r_us", "l_context", "r_context", "r_actor_raw"), "paths")
    acks = c.filter(F.array_contains("acts", "ack")).select("cluster_id", F.col("actor_raw").alias("r_actor_raw"), F.col("event_key").alias("ack_key"), F.col("us").alias("a_us"), F.col("ingest_ord").alias("a_ord"), F.col("refs").alias("a_refs"), F.col("ancestors").alias("a_ancestors"), F.col("context").alias("a_context"))
    between = paths.join(acks, ["cluster_id", "r_actor_raw"]).filter("l_us < a_us AND a_us < r_us AND ack_key <> left_key AND ack_key <> right_key")
    between = between.filter(F.when(F.col("native"), F.array_contains("a_ancestors", F.col("left_key"))).otherwise(F.arrays_overlap("shared", "a_refs")))
    first = between.groupBy("cluster_id", "path_no").agg(F.min(F.struct("a_us", "a_ord", "ack_key", "a_context")).alias("ack"))
    paths = paths.join(first, ["cluster_id", "path_no"], "left")
    complete = F.col("ack").isNotNull() | (F.col("kind") == "checkpoint_resume")
    contexts = F.size(F.array_distinct(F.array_compact(F.array("l_context", "r_context", "ack.a_context"))))
    per = paths.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        F.count("ack").alias("acks"),
        F.count_if(F.col("native") & complete).alias("verified_native"),
        F.count_if(~F.col("native") & complete & (contexts >= 2)).alias("verified_cross"),
        F.bool_or(F.col("kind") == "checkpoint_resume").alias("resumed"),
        F.bool_or(~F.col("native")).alias("by_reference"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set(F.when(F.col("native"), "native_reply").otherwise("shared_reference"))).alias("link_types"),
        F.sort_array(F.array_distinct(F.concat(F.collect_set("left_key"), F.collect_set("right_key"), F.collect_set("ack.ack_key")))).alias("ids"),
        F.transform(F.sort_array(F.collect_list(F.struct("path_no", F.concat_ws(":", F.lit("semantic"), "kind", "left_key", "right_key").alias("g")))), lambda x: x["g"]).alias("groups"),
    )
    evidence = _strings(
        F.concat(F.lit("paths="), F.col("n").cast("string")),
        F.concat(F.lit("path_types="), F.array_join("kinds", ",")),
        F.concat(F.lit("link_types="), F.array_join("link_types", ",")),
        F.concat(F.lit("distinct_acknowledgements="), F.col("acks").cast("string")),
        F.concat(F.lit("verified_native_trajectories="), F.col("verified_native").cast("string")),
        F.concat(F.lit("verified_cross_context_trajectories="), F.col("verified_cross").cast("string")),
    )
    return _exchanged(per, evidence, F.col("groups"), F.col("verified_cross"))


def _exchanged(per: DataFrame, evidence: Column, groups: Column | None = None, cross: Column | None = None) -> DataFrame:
    base = F.when(F.col("acks") > 0, 0.94).when(F.col("resumed"), 0.90).otherwise(0.78)
    depends = F.when(F.col("by_reference"), F.array(F.lit("artifact"))).otherwise(F.array().cast("array<string>"))
    return _signal(per, "semantic", "linked_coordination_exchange", F.least(F.lit(0.98), base + 0.02 * (F.col("n") - 1)), 2, ids=F.col("ids"), evidence=evidence, groups=groups, depends=depends, native=F.col("verified_native"), cross_context=cross)


def _side_references(c: DataFrame) -> DataFrame:
    """(cluster_id, kind, side, row, event_key, us, actor_raw, sig): of left (1) and right (2) rows the references that stand
    on both sides of their cluster, sorted."""
    sides = None
    for kind, left_act, right_act in _KINDS:
        for side, act in ((1, left_act), (2, right_act)):
            own = c.filter(F.array_contains("acts", act)).select("cluster_id", F.lit(kind).alias("kind"), F.lit(side).alias("side"), "row", "event_key", "us", "actor_raw", F.explode("refs").alias("ref"))
            sides = own if sides is None else sides.union(own)
    both = sides.groupBy("cluster_id", "kind", "ref").agg(F.count_distinct("side").alias("sides")).filter("sides = 2").drop("sides")
    held = sides.join(both.hint("merge"), ["cluster_id", "kind", "ref"])
    return held.groupBy("cluster_id", "kind", "side", "row").agg(*[F.first(x).alias(x) for x in ("event_key", "us", "actor_raw")], F.array_sort(F.collect_set("ref")).alias("sig"))


def _native_paths(c: DataFrame, sides: DataFrame, groups: DataFrame) -> DataFrame:
    """Paths along replies, at most 16 for each right row; ``g``: the group that counts the path too, if references are
    shared; ``ack``: the first acknowledgement along replies."""
    found = None
    for kind, left_act, right_act in _KINDS:
        right = c.filter(F.array_contains("acts", right_act)).select("cluster_id", F.explode("ancestors").alias("left_key"), F.col("row").alias("r_row"), F.col("event_key").alias("right_key"), F.col("us").alias("r_us"), F.col("actor_raw").alias("r_raw"))
        left = c.filter(F.array_contains("acts", left_act)).select("cluster_id", F.col("event_key").alias("left_key"), F.col("row").alias("l_row"), F.col("us").alias("l_us"), F.col("actor_raw").alias("l_raw"))
        paths = right.join(left.hint("merge"), ["cluster_id", "left_key"]).filter("l_us <= r_us AND l_raw <> r_raw").withColumn("kind", F.lit(kind))
        found = paths if found is None else found.union(paths)
    for side, name in ((1, "l"), (2, "r")):
        found = found.join(sides.filter(F.col("side") == side).select("kind", F.col("row").alias(f"{name}_row"), F.col("sig").alias(f"{name}sig")).hint("merge"), ["kind", f"{name}_row"], "left")
    found = found.join(groups.select("cluster_id", "kind", "lsig", "rsig", "g").hint("merge"), ["cluster_id", "kind", "lsig", "rsig"], "left").drop("lsig", "rsig", "l_row", "r_row")
    found = written(found, "native")
    acks = c.filter(F.array_contains("acts", "ack")).select("cluster_id", F.explode("ancestors").alias("left_key"), F.col("actor_raw").alias("r_raw"), F.struct(*_TIME, "event_key").alias("ack"))
    # The first one after the left row is a right row's if it stands before it.
    by = ["cluster_id", "left_key", "r_raw"]
    first = acks.join(found.select(*by, "l_us").distinct().hint("merge"), by).filter("ack.us > l_us").groupBy(*by, "l_us").agg(F.min("ack").alias("ack"))
    return found.join(first.hint("merge"), [*by, "l_us"], "left").withColumn("ack", F.when(F.col("ack.us") < F.col("r_us"), F.col("ack")))


def exchange_totals(c: DataFrame) -> DataFrame:
    """The signal of ``exchange`` over all paths of a cluster, which are counted instead of listed (so without their groups
    and contexts).

    Rows with the same references, of those that stand on both sides, meet the others as a group: a right row ends as many
    paths as left rows of other actors came before it. Of these as many are acknowledged as came before the right actor's
    last acknowledgement. So a group's rows are sorted, not paired. Paths along replies are listed, at most 16 for each row,
    and what a group counted of them is taken off.
    """
    lines = ancestors(c.select("cluster_id", "event_key", "parent_key"))
    acting = c.filter((F.size("acts") > 0) & F.col("us").isNotNull() & F.col("actor_raw").isNotNull())
    c = written(_with_lines(acting.select("cluster_id", "event_key", *_TIME, "actor_raw", "acts", "refs"), lines).withColumn("row", F.monotonically_increasing_id()), "acting")
    sides = written(_side_references(c), "sides")
    sigs = sides.select("cluster_id", "kind", "side", "sig").distinct().withColumn("ref", F.explode("sig"))
    left_sigs, right_sigs = (sigs.filter(F.col("side") == side).select("cluster_id", "kind", "ref", F.col("sig").alias(name)) for side, name in ((1, "lsig"), (2, "rsig")))
    groups = written(left_sigs.join(right_sigs.hint("merge"), ["cluster_id", "kind", "ref"]).select("cluster_id", "kind", "lsig", "rsig").distinct().withColumn("g", F.monotonically_increasing_id()), "groups")
    native = written(_native_paths(c, sides, groups), "native")

    cols = ["cluster_id", "kind", "g", "side", *_TIME, "actor_raw", "event_key"]
    sides = sides.withColumn("ingest_ord", F.lit(None).cast(c.schema["ingest_ord"].dataType))
    members = None
    for side, name in ((1, "lsig"), (2, "rsig")):
        own = sides.filter(F.col("side") == side).withColumnRenamed("sig", name).join(groups.select("cluster_id", "kind", name, "g").hint("merge"), ["cluster_id", "kind", name]).select(*cols)
        members = own if members is None else members.union(own)
    shared = groups.select("cluster_id", "kind", "g", F.explode(F.array_intersect("lsig", "rsig")).alias("ref"))
    acks = c.filter(F.array_contains("acts", "ack")).withColumn("ref", F.explode("refs")).join(shared.hint("merge"), ["cluster_id", "ref"]).withColumn("side", F.lit(0)).dropDuplicates(["g", "row"]).select(*cols)
    acks = written(acks, "acks")
    # Of rows at one time acknowledgements come first and right rows last.
    left, right, ack = ((F.col("side") == side) for side in (1, 2, 0))
    running = (Window.unboundedPreceding, Window.currentRow)
    mine = Window.partitionBy("g", "actor_raw")
    placed, timed = mine.orderBy("us", "side", "ingest_ord", "event_key"), mine.orderBy("us")
    rows = members.union(acks).withColumn("lefts", F.sum(left.cast("long")).over(Window.partitionBy("g").orderBy("us", "side").rowsBetween(*running)))
    rows = rows.withColumns({"lefts": F.col("lefts") - F.sum(left.cast("long")).over(placed.rowsBetween(*running)), "before": F.lag(F.struct("us", "side")).over(placed)})
    earlier = F.max(F.when(ack, F.col("lefts"))).over(timed.rangeBetween(Window.unboundedPreceding, -1))
    later = F.sum(right.cast("long")).over(mine) - F.sum(right.cast("long")).over(timed.rangeBetween(*running))
    rows = rows.withColumns({"acked": F.coalesce(earlier, F.lit(0)), "later": later})
    # Of acknowledgements at one time the first counts.
    first = ack & ~F.col("before").eqNullSafe(F.struct("us", "side"))
    rows = written(rows.filter(right | first).select("cluster_id", "kind", "g", "side", "us", "actor_raw", "event_key", "lefts", "acked", "later").filter("lefts > 0"), "counted")

    # By the time that its group would give a path along replies: the first acknowledgement after the left row.
    probes = native.filter("g IS NOT NULL").select("cluster_id", "kind", "g", F.lit(1).alias("side"), F.col("l_us").alias("us"), F.col("r_raw").alias("actor_raw"), "r_us")
    backward = mine.orderBy(-F.col("us")).rangeBetween(Window.unboundedPreceding, -1)
    met = acks.select("cluster_id", "kind", "g", "side", "us", "actor_raw", F.lit(None).cast("long").alias("r_us")).union(probes).withColumn("ack_us", F.min(F.when(ack, F.col("us"))).over(backward)).filter("side = 1 AND ack_us < r_us")
    met = written(met.groupBy("cluster_id", "kind", "g", "actor_raw", F.col("ack_us").alias("us")).agg(F.count("*").alias("along")), "met")

    by = ["cluster_id", "kind"]
    by_reference = rows.filter(right).groupBy(*by).agg(F.sum("lefts").alias("n"), F.sum("acked").alias("acks"))
    twice = met.groupBy(*by).agg(F.sum("along").alias("acks_twice"))
    done = F.col("ack").isNotNull() | (F.col("kind") == "checkpoint_resume")
    by_reply = native.groupBy(*by).agg(F.count("*").alias("native"), F.count("g").alias("n_twice"), F.count("ack").alias("native_acks"), F.count_if(done).alias("done"))
    per = by_reference.join(by_reply, by, "full").join(twice, by, "left").na.fill(0)
    n, other = F.col("n") - F.col("n_twice") + F.col("native"), F.col("n") - F.col("n_twice")
    per = per.groupBy("cluster_id").agg(
        F.sum(n).alias("n"),
        F.sum(F.col("acks") - F.col("acks_twice") + F.col("native_acks")).alias("acks"),
        F.sum("done").alias("verified_native"),
        F.bool_or(F.col("kind") == "checkpoint_resume").alias("resumed"),
        F.bool_or(other > 0).alias("by_reference"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.array_union(F.collect_set(F.when(F.col("native") > 0, "native_reply")), F.collect_set(F.when(other > 0, "shared_reference")))).alias("link_types"),
    )
    # A left row opens a path if the last right row of another actor does not come before it.
    last = sides.filter(right).withColumnRenamed("sig", "rsig").join(groups.select(*by, "rsig", "g").hint("merge"), [*by, "rsig"]).groupBy("g", "actor_raw").agg(F.max("us").alias("us"))
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("us"), "actor_raw"))
    last = last.withColumn("_n", best).filter("_n <= 2").groupBy("g").agg(F.max(F.when(F.col("_n") == 1, F.struct("us", "actor_raw"))).alias("one"), F.max(F.when(F.col("_n") == 2, F.col("us"))).alias("two"))
    opens = members.filter(left).join(last.hint("merge"), "g").filter(F.col("us") <= F.when(F.col("one.actor_raw") != F.col("actor_raw"), F.col("one.us")).otherwise(F.col("two")))
    # An acknowledgement is a path's if left rows came since the one before it and right rows follow; paths along replies have their own.
    used = rows.filter(ack).join(met.drop("cluster_id", "kind").hint("merge"), ["g", "actor_raw", "us"], "left").filter((F.col("lefts") - F.col("acked")) * F.col("later") > F.coalesce("along", F.lit(0)))
    keys = opens.select("cluster_id", "event_key").union(rows.filter(right).select("cluster_id", "event_key")).union(used.select("cluster_id", "event_key"))
    keys = keys.union(native.select("cluster_id", F.explode(F.array_compact(F.array("left_key", "right_key", "ack.event_key")))))
    per = per.join(keys.groupBy("cluster_id").agg(F.sort_array(F.collect_set("event_key")).alias("ids")).hint("merge"), "cluster_id")
    evidence = _strings(
        F.concat(F.lit("paths="), F.col("n").cast("string")),
        F.concat(F.lit("path_types="), F.array_join("kinds", ",")),
        F.concat(F.lit("link_types="), F.array_join("link_types", ",")),
        F.concat(F.lit("distinct_acknowledgements="), F.col("acks").cast("string")),
        F.concat(F.lit("verified_native_trajectories="), F.col("verified_native").cast("string")),
    )
    return _exchanged(per, evidence)


def _context() -> Column:
    return F.coalesce("conversation_key", "resource_key", "event_key")


def artifact_uses(c: DataFrame) -> DataFrame:
    """(cluster_id, kind, value, actors, contexts, keys) of artifacts that two actors of a cluster used."""
    uses = c.select("cluster_id", "actor_key", "event_key", _context().alias("context"), F.explode("artifacts").alias("x"))
    per = uses.groupBy("cluster_id", "x.kind", "x.value").agg(F.count_distinct("actor_key").alias("actors"), F.count_distinct("context").alias("contexts"), F.collect_set("event_key").alias("keys"))
    return per.filter("actors >= 2")


def artifact_reuse(c: DataFrame) -> DataFrame:
    plain = F.col("value").rlike(X.UUID) | F.col("value").rlike(X.HASH)
    base = F.when(F.col("kind").startswith("marker:"), F.when(plain, 0.58).otherwise(0.82)).when(F.col("kind") == "code", 0.66).otherwise(0.56)
    used = artifact_uses(c).withColumn("strength", F.least(F.lit(0.95), base + 0.08 * (F.col("contexts") - 1)))
    rank = Window.partitionBy("cluster_id").orderBy("kind", "value")
    shown = used.withColumn("_n", F.row_number().over(rank)).withColumn("d", F.substring(F.sha2("value", 256), 1, 16))
    line = F.concat("kind", F.lit(":sha256="), "d", F.lit(":actors="), "actors", F.lit(":contexts="), "contexts")
    item = F.when(F.col("_n") <= 20, F.struct("_n", line.alias("line"), F.concat(F.lit("artifact:"), "d").alias("g"), "keys"))
    per = shown.groupBy("cluster_id").agg(F.max("strength").alias("strongest"), F.max("actors").alias("actors"), F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items")).filter("strongest >= 0.55")
    score = F.least(F.lit(0.98), F.col("strongest") + 0.04 * (F.col("actors") - 2) + 0.03 * (F.col("n") - 1))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("items", lambda x: x["keys"]))))
    return _signal(per, "artifact", "cross_actor_typed_artifact_reuse", score, 3, ids=ids, evidence=F.transform("items", lambda x: x["line"]), groups=F.transform("items", lambda x: x["g"]))


def identity_markers(c: DataFrame) -> DataFrame:
    uses = c.select("cluster_id", "actor_key", "event_key", _context().alias("context"), F.explode("identity_markers").alias("marker"))
    shared = uses.groupBy("cluster_id", "marker").agg(F.count_distinct("actor_key").alias("actors"), F.count_distinct("context").alias("contexts"), F.collect_set("event_key").alias("keys")).filter("actors >= 2 AND contexts >= 2")
    line = F.concat(F.lit("marker_sha256="), F.substring(F.sha2("marker", 256), 1, 16), F.lit(" actors="), "actors", F.lit(" contexts="), "contexts")
    per = shared.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("marker", line.alias("line"), F.concat(F.lit("identity:"), F.sha2("marker", 256)).alias("g"), "keys"))).alias("items"))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("items", lambda x: x["keys"]))))
    return _signal(per, "identity", "shared_identity_marker", F.least(F.lit(1.0), 0.65 + 0.08 * F.col("n")), 4, ids=ids, evidence=F.transform(F.slice("items", 1, 10), lambda x: x["line"]), groups=F.transform("items", lambda x: x["g"]))


def _large(c: DataFrame) -> DataFrame | None:
    """Clusters whose medians need more than one buffer."""
    large = written(c.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") > MEDIAN_ROWS).select("cluster_id", F.lit(True).alias("large")), "large")
    return None if large.isEmpty() else large


def _with_medians(steps: DataFrame, gap_us: Column, large: DataFrame | None, *others: Column) -> DataFrame:
    """Aggregates of clusters, with ``med``, the median of their gaps in seconds: in a buffer, or for ``large`` clusters by
    counting digits."""
    if large is None:
        return steps.groupBy("cluster_id").agg(F.median(gap_us / MICROS).alias("med"), *others)
    steps = written(steps.withColumn("gap_", gap_us).join(large, "cluster_id", "left"), "steps")
    per = steps.groupBy("cluster_id").agg(F.median(F.when(F.col("large").isNull(), F.col("gap_") / MICROS)).alias("small_"), *others)
    found = medians(steps.filter("large").select("cluster_id", "gap_"), ["cluster_id"], "gap_").select("cluster_id", (0.5 * (F.col("low") / MICROS) + 0.5 * (F.col("high") / MICROS)).alias("large_"))
    return per.join(found, "cluster_id", "left").withColumn("med", F.coalesce("large_", "small_")).drop("large_", "small_")


def handoffs(c: DataFrame) -> DataFrame:
    rows = previous(c.select("cluster_id", "actor_raw", "artifacts", "parent_key", "us", "ingest_ord", "event_key"), ["cluster_id"], _TIME, ["event_key", "actor_raw", "artifacts", "us"])
    reply = F.col("prev").isNotNull() & F.col("parent_key").eqNullSafe(F.col("prev.event_key")) & F.col("prev.event_key").isNotNull()
    shared = F.coalesce(F.arrays_overlap("artifacts", "prev.artifacts"), F.lit(False))
    changed = F.coalesce(F.col("actor_raw") != F.col("prev.actor_raw"), F.lit(False))
    steps = rows.select("cluster_id", "actor_raw", "us", "ingest_ord", "event_key", changed.alias("changed"), reply.alias("reply"), shared.alias("shared"), (F.col("us") - F.col("prev.us")).alias("gap"))
    linked = F.col("changed") & (F.col("reply") | F.col("shared"))
    per = _with_medians(
        steps,
        F.when(linked, F.greatest(F.col("gap"), F.lit(0))),
        _large(c),
        F.count("*").alias("n"),
        F.count_distinct("actor_raw").alias("actors"),
        F.count_if(linked).alias("changes"),
        F.bool_or(linked & ~F.col("reply")).alias("by_artifact"),
        _keys_in_order().alias("ids"),
    )
    per = per.filter("n >= 4 AND actors >= 2 AND changes > 0").withColumn("density", F.col("changes") / (F.col("n") - 1))
    latency = F.when(F.col("med") <= 10, 1.0).when(F.col("med") <= 60, 0.85).when(F.col("med") <= 300, 0.60).otherwise(0.25)
    depends = F.when(F.col("by_artifact"), F.array(F.lit("artifact"))).otherwise(F.array().cast("array<string>"))
    evidence = _strings(F.concat(F.lit("median_cross_actor_gap_seconds="), _two(F.col("med"))), F.concat(F.lit("actor_change_density="), _two(F.col("density"))))
    return _signal(per, "temporal", "rapid_cross_actor_handoffs", F.least(F.lit(1.0), 0.65 * latency + 0.35 * F.col("density")), 5, ids=F.col("ids"), evidence=evidence, depends=depends)


def periodicity(c: DataFrame) -> DataFrame:
    rows = previous(c.select("cluster_id", "us", "ingest_ord", "event_key"), ["cluster_id"], _TIME, ["us"])
    passed = F.col("us") - F.col("prev.us")
    gaps = rows.withColumns({"gap": passed / MICROS, "positive": F.when(passed > 0, passed)}).drop("prev")
    middle = _with_medians(gaps, F.col("positive"), _large(c), F.count("*").alias("n"), F.count("positive").alias("gaps")).filter("n >= 6 AND gaps >= 5 AND med > 0")
    per = gaps.join(middle, "cluster_id").groupBy("cluster_id", "gaps", "med").agg(F.count_if((F.col("gap") > 0) & (F.abs(F.col("gap") - F.col("med")) / F.col("med") <= 0.10)).alias("near"), _keys_in_order().alias("ids"))
    per = per.withColumn("regular", F.col("near") / F.col("gaps")).filter("regular >= 0.60")
    evidence = _strings(F.concat(F.lit("median_gap_seconds="), _two(F.col("med"))), F.concat(F.lit("regular_fraction="), _two(F.col("regular"))))
    return _signal(per, "temporal", "periodic_activity", F.least(F.lit(0.85), 0.35 + F.col("regular") * 0.5), 6, ids=F.col("ids"), evidence=evidence)


def benign(c: DataFrame) -> DataFrame:
    repeated = c.filter("is_bot AND template IS NOT NULL").groupBy("cluster_id", "template").agg(F.count("*").alias("k")).groupBy("cluster_id").agg(F.sum(F.when(F.col("k") >= 2, F.col("k")).otherwise(0)).alias("repeated"))
    per = c.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("is_bot").alias("bots"), F.count_if(F.col("is_bot") & F.col("is_routine")).alias("both"), _keys_in_order().alias("ids")).filter("both > 0").join(repeated, "cluster_id", "left")
    share = {k: F.coalesce(F.col(k), F.lit(0)) / F.col("n") for k in ("bots", "both", "repeated")}
    per = per.withColumns({f"s_{k}": v for k, v in share.items()}).withColumn("score", F.least(F.lit(1.0), 0.15 * F.col("s_bots") + 0.75 * F.col("s_both") + 0.10 * F.col("s_repeated"))).filter("score >= 0.20")
    evidence = _strings(*[F.concat(F.lit(f"{name}="), _two(F.col(f"s_{k}"))) for name, k in (("bot_or_app_fraction", "bots"), ("composite_routine_fraction", "both"), ("repeated_template_fraction", "repeated"))])
    return _signal(per, "benign", "routine_automation_fingerprint", F.col("score"), 7, ids=F.col("ids"), evidence=evidence)


def opaque_exchange(c: DataFrame) -> DataFrame:
    hits = c.select("cluster_id", "actor_key", "event_key", "us", "ingest_ord", F.posexplode("opaque").alias("pos", "payload"))
    rows = previous(hits, ["cluster_id"], [*_TIME, "pos"], ["actor_key", "us"])
    steps = rows.withColumns({"changed": (F.col("actor_key") != F.col("prev.actor_key")).cast("double"), "fast": (F.col("us") - F.col("prev.us") <= 60 * MICROS).cast("double")})
    per = steps.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("actor_key").alias("actors"), F.avg("changed").alias("alternation"), F.avg("fast").alias("fast"), F.transform(F.sort_array(F.collect_list(F.struct("us", "ingest_ord", "pos", "event_key"))), lambda x: x["event_key"]).alias("ids"))
    per = per.filter("n >= 6 AND actors >= 2 AND alternation >= 0.60 AND fast >= 0.25")
    evidence = _strings(F.concat(F.lit("opaque_payload_count="), F.col("n").cast("string")), F.concat(F.lit("actor_count="), F.col("actors").cast("string")), F.concat(F.lit("alternation="), _two(F.col("alternation"))), F.concat(F.lit("fast_gap_fraction="), _two(F.col("fast"))))
    return _signal(per, "artifact", "opaque_cross_actor_exchange", F.least(F.lit(0.99), 0.68 + 0.20 * F.col("alternation") + 0.12 * F.col("fast")), 8, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("behavior:opaque_exchange")), exceptional=True)


def shared_credential(c: DataFrame) -> DataFrame:
    uses = c.select("cluster_id", "actor_key", "resource_key", "event_key", F.explode("credentials").alias("value"))
    shared = uses.groupBy("cluster_id", "value").agg(F.count_distinct("actor_key").alias("a"), _all("resource_key").alias("r")).filter("a >= 2 AND r >= 2").select("cluster_id", "value")
    per = uses.join(shared, ["cluster_id", "value"]).groupBy("cluster_id").agg(F.count_distinct("value").alias("values"), F.count_distinct("actor_key").alias("actors"), _all("resource_key").alias("resources"), F.sort_array(F.collect_set("event_key")).alias("ids"))
    evidence = _strings(*[F.concat(F.lit(f"{name}="), F.col(k).cast("string")) for name, k in (("shared_credential_count", "values"), ("actor_count", "actors"), ("resource_count", "resources"))])
    return _signal(per, "identity", "shared_credential_across_identities", F.least(F.lit(0.99), 0.88 + 0.02 * (F.col("actors") - 2)), 9, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("identity:shared_credential")), exceptional=True)


def _activity(c: DataFrame) -> DataFrame:
    bins = F.count_distinct(F.floor(F.col("us") / HOUR) % 24 - F.floor(F.col("us") / HOUR) % 4)
    return c.filter("NOT is_bot").groupBy("cluster_id", "actor_key").agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / HOUR).alias("span"), bins.alias("bins"), F.count_distinct("resource_key").alias("resources"), F.min(F.struct(*_TIME)).alias("first"))


def round_the_clock(c: DataFrame, keys: bool = True) -> DataFrame:
    top = c.filter("NOT is_bot AND words <> ''").groupBy("cluster_id", "actor_key", "words").count().groupBy("cluster_id", "actor_key").agg(F.max("count").alias("top"))
    per = _activity(c).filter("n >= 10 AND span >= 36 AND bins >= 5").join(top, ["cluster_id", "actor_key"], "left").withColumn("repetition", F.coalesce("top", F.lit(0)) / F.col("n")).filter("resources >= 2 OR repetition >= 0.45")
    if keys:
        ids = c.filter("NOT is_bot").join(per.select("cluster_id", "actor_key"), ["cluster_id", "actor_key"], "left_semi").groupBy("cluster_id", "actor_key").agg(_keys_in_order().alias("ids"))
        per = per.join(ids, ["cluster_id", "actor_key"])
    score = F.least(F.lit(0.96), 0.48 + 0.16 * F.least(F.lit(1.0), F.col("span") / 72) + 0.16 * (F.col("bins") / 6) + 0.12 * F.least(F.lit(1.0), F.col("resources") / 3) + 0.08 * F.col("repetition"))
    evidence = _strings(F.concat(F.lit("span_hours="), F.format_string("%.1f", "span")), F.concat(F.lit("utc_four_hour_bins="), F.col("bins").cast("string")), F.concat(F.lit("resource_count="), F.col("resources").cast("string")), F.concat(F.lit("dominant_text_fraction="), _two(F.col("repetition"))))
    order = F.row_number().over(Window.partitionBy("cluster_id").orderBy("first.ingest_ord", "actor_key"))
    return _signal(per, "behavior", "round_the_clock_objective_persistence", score, 10, signal_ord=order, ids=F.col("ids") if keys else None, evidence=evidence, groups=_strings(F.concat(F.lit("behavior:activity:"), "actor_key")), longitudinal=True, cross=F.col("resources") >= 2, exceptional=(F.col("resources") >= 3) & (F.col("repetition") >= 0.80))


#: The order of a signal's observations in ``shift_coverage``.
COVERING_ORDER = ["actor_key", *_TIME, "event_key"]


def covering(c: DataFrame) -> DataFrame:
    """The rows of actors that ``shift_coverage`` counts, whose keys its signal lists."""
    actors = _activity(c).filter("n >= 8 AND span >= 36 AND bins >= 4").select("cluster_id", "actor_key")
    return c.filter("NOT is_bot").join(actors, ["cluster_id", "actor_key"], "left_semi")


def shift_coverage(c: DataFrame) -> DataFrame:
    per = covering(c).groupBy("cluster_id").agg(F.count_distinct("actor_key").alias("k"), _all("resource_key").alias("resources"), F.transform(F.sort_array(F.collect_list(F.struct(*COVERING_ORDER))), lambda x: x["event_key"]).alias("ids")).filter("k >= 2")
    evidence = _strings(F.concat(F.lit("qualifying_actor_count="), F.col("k").cast("string")), F.lit("minimum_span_hours=36"), F.lit("minimum_utc_four_hour_bins_per_actor=4"))
    return _signal(per, "behavior", "multi_actor_continuous_shift_coverage", F.least(F.lit(0.98), 0.88 + 0.02 * F.col("k")), 11, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("behavior:continuous_shift_coverage")), longitudinal=True, cross=F.col("resources") >= 2, exceptional=True)


def style_reuse(c: DataFrame) -> DataFrame:
    rows = c.filter("structured AND length(words) >= 18").select("cluster_id", "words", "actor_key", "event_key")
    reused = rows.groupBy("cluster_id", "words").agg(F.count("*").alias("k"), F.count_distinct("actor_key").alias("a")).filter("k >= 4 AND a >= 2").select("cluster_id", "words")
    per = rows.join(reused, ["cluster_id", "words"]).groupBy("cluster_id").agg(F.count_distinct("words").alias("templates"), F.count("*").alias("n"), F.count_distinct("actor_key").alias("actors"), F.sort_array(F.collect_set("event_key")).alias("ids"))
    evidence = _strings(*[F.concat(F.lit(f"{name}="), F.col(k).cast("string")) for name, k in (("reused_template_count", "templates"), ("matching_observation_count", "n"), ("actor_count", "actors"))])
    return _signal(per, "semantic", "cross_actor_structural_style_reuse", F.least(F.lit(0.88), 0.62 + 0.03 * F.col("n")), 12, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("semantic:style_reuse")))


def _pushes(c: DataFrame) -> DataFrame:
    """Push events of clusters that have at least five."""
    pushes = c.filter("is_push")
    return pushes.join(pushes.groupBy("cluster_id").count().filter("count >= 5").select("cluster_id"), "cluster_id", "left_semi")


def commit_intervals(c: DataFrame) -> DataFrame:
    rows = previous(_pushes(c).select("cluster_id", "actor_key", "event_key", *_TIME), ["cluster_id", "actor_key"], _TIME, ["event_key", "us"])
    steps = rows.select("cluster_id", "event_key", F.col("prev.event_key").alias("before"), (F.col("us") - F.col("prev.us")).alias("gap"))
    exact = (F.col("gap") > 0) & (F.col("gap") % (60 * MICROS) == 0) & (F.col("gap") <= 6 * HOUR)
    per = steps.groupBy("cluster_id").agg(F.count_if(exact).alias("exact"), F.count_if(F.col("gap") > 0).alias("gaps"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(exact, F.array("before", "event_key")))))).alias("ids"))
    per = per.withColumn("share", F.col("exact") / F.greatest(F.lit(1), F.col("gaps"))).filter("exact >= 4 AND share >= 0.75")
    evidence = _strings(F.concat(F.lit("exact_minute_gap_count="), F.col("exact").cast("string")), F.concat(F.lit("exact_gap_fraction="), _two(F.col("share"))))
    return _signal(per, "commit", "machine_exact_commit_intervals", F.least(F.lit(0.90), 0.55 + 0.35 * F.col("share")), 13, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("commit:timing")))


def commit_templates(c: DataFrame, keys: bool = True) -> DataFrame:
    pushes = _pushes(c)
    said = pushes.select("cluster_id", F.explode("commit_messages").alias("m")).filter(F.trim("m") != "")
    per = said.groupBy("cluster_id", X.commit_template(F.col("m")).alias("t")).count().groupBy("cluster_id").agg(F.sum("count").alias("n"), F.max("count").alias("top")).withColumn("dominant", F.col("top") / F.col("n")).filter("n >= 8 AND dominant >= 0.70")
    if keys:
        per = per.join(pushes.groupBy("cluster_id").agg(_keys_in_order().alias("ids")), "cluster_id")
    evidence = _strings(F.concat(F.lit("commit_message_count="), F.col("n").cast("string")), F.concat(F.lit("dominant_template_fraction="), _two(F.col("dominant"))))
    return _signal(per, "commit", "uniform_commit_message_template", F.least(F.lit(0.88), 0.52 + 0.40 * F.col("dominant")), 14, ids=F.col("ids") if keys else None, evidence=evidence, groups=_strings(F.lit("commit:message_style")))


def commit_domains(c: DataFrame) -> DataFrame:
    uses = _pushes(c).select("cluster_id", "actor_key", "event_key", F.explode(F.transform("email_domains", F.lower)).alias("domain")).filter(F.col("domain").rlike(X.GENERATED_DOMAIN))
    shared = uses.groupBy("cluster_id", "domain").agg(F.count_distinct("actor_key").alias("a"), F.collect_set("event_key").alias("keys")).filter("a >= 3")
    per = shared.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("a").alias("a"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("ids"))
    evidence = _strings(F.concat(F.lit("generated_domain_count="), F.col("n").cast("string")), F.concat(F.lit("max_actor_count="), F.col("a").cast("string")))
    return _signal(per, "commit", "shared_generated_author_domain", F.least(F.lit(0.86), 0.62 + 0.05 * F.col("a")), 15, ids=F.col("ids"), evidence=evidence, groups=_strings(F.lit("commit:author_domain")))


def reply_edges(c: DataFrame) -> DataFrame:
    """(cluster_id, src, dst, weight): an actor, one who replied to it, and how often."""
    child = c.filter("parent_key IS NOT NULL").select("cluster_id", F.col("parent_key").alias("event_key"), F.col("actor_key").alias("dst"))
    both = child.join(c.select("cluster_id", "event_key", F.col("actor_key").alias("src")).hint("merge"), ["cluster_id", "event_key"]).filter("src <> dst")
    return both.groupBy("cluster_id", "src", "dst").agg(F.count("*").alias("weight"))


def graph_tables(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, relation, weight) of the heterogeneous graph of observations with features."""
    event = F.concat(F.lit("event:"), "event_key")
    actor = F.concat(F.lit("actor:"), "actor_key")
    held = obs.select(event.alias("src"), F.explode("artifacts").alias("x")).select("src", F.concat_ws(":", F.lit("artifact"), "x.kind", F.sha2("x.value", 256)).alias("dst"))
    repo = F.concat(F.lit("repo:"), "repository")
    known = obs.select("event_key").hint("merge")
    replies = obs.filter("parent_key IS NOT NULL").join(known.withColumnRenamed("event_key", "parent_key"), "parent_key", "left_semi")
    answered = reply_edges(obs.withColumn("cluster_id", F.lit("")))
    nodes = obs.select(actor.alias("id"), F.lit("actor").alias("kind")).union(obs.select(event, F.lit("event"))).union(obs.filter("repository <> ''").select(repo, F.lit("repository"))).union(held.select("dst", F.lit("artifact"))).distinct()
    edges = (
        obs.select(actor.alias("src"), event.alias("dst"), F.lit("authored").alias("relation"), F.lit(1).cast("long").alias("weight"))
        .union(obs.filter("repository <> ''").select(event, repo, F.lit("in_repository"), F.lit(1).cast("long")))
        .union(replies.select(F.concat(F.lit("event:"), "parent_key"), event, F.lit("reply_to"), F.lit(1).cast("long")))
        .union(answered.select(F.concat(F.lit("actor:"), "src"), F.concat(F.lit("actor:"), "dst"), F.lit("responded_to"), "weight"))
        .union(held.select("src", "dst", F.lit("contains"), F.lit(1).cast("long")))
    )
    return nodes, edges


def _topology(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = written(reply_edges(c), "replies")
    mutual = edges.join(edges.select("cluster_id", F.col("src").alias("dst"), F.col("dst").alias("src")), ["cluster_id", "src", "dst"], "left_semi").groupBy("cluster_id").agg(F.count("*").alias("mutual"))
    out = edges.groupBy("cluster_id", "src").agg(F.count("*").alias("out")).groupBy("cluster_id").agg(F.max("out").alias("max_out"), F.sum("out").alias("edges"))
    cycles = largest(edges)
    actors = c.groupBy("cluster_id").agg(F.count_distinct("actor_key").alias("actors")).filter("actors >= 2")
    per = actors.join(out, "cluster_id").join(cycles, "cluster_id").join(mutual, "cluster_id", "left")
    per = per.withColumn("reciprocity", F.coalesce("mutual", F.lit(0)) / F.col("edges"))
    score = F.least(F.lit(1.0), 0.45 * F.col("reciprocity") + 0.35 * F.least(F.lit(1.0), F.col("max_out") / 4.0) + 0.20 * F.least(F.lit(1.0), (F.col("scc") - 1) / 4.0))
    return edges, per.withColumn("score", score).filter("score >= 0.25")


def topology(c: DataFrame) -> DataFrame:
    edges, per = _topology(c)
    evidence = _strings(F.concat(F.lit("actor_count="), F.col("actors").cast("string")), F.concat(F.lit("actor_edges="), F.col("edges").cast("string")), F.concat(F.lit("reciprocity="), _two(F.col("reciprocity"))), F.concat(F.lit("max_out_degree="), F.col("max_out").cast("string")), F.concat(F.lit("largest_scc="), F.col("scc").cast("string")))
    shape = _signal(per, "graph", "coordination_topology", F.col("score"), 16, evidence=evidence)
    seen = c.groupBy("cluster_id", F.col("actor_key").alias("src")).agg(F.min("ingest_ord").alias("seen"))
    leaders = edges.filter("weight >= 2").groupBy("cluster_id", "src").agg(F.count("*").alias("workers"), F.sum("weight").alias("responses")).filter("workers >= 3").join(seen, ["cluster_id", "src"])
    best = leaders.groupBy("cluster_id").agg(F.max_by(F.struct("workers", "responses"), F.struct("workers", -F.col("seen"))).alias("b")).select("cluster_id", "b.*").join(per.select("cluster_id"), "cluster_id", "left_semi")
    evidence = _strings(F.concat(F.lit("worker_count="), F.col("workers").cast("string")), F.concat(F.lit("repeated_response_count="), F.col("responses").cast("string")), F.lit("relationship_source=native_reply_edges"))
    lead = _signal(best, "graph", "repeated_leader_worker_aggregation", F.least(F.lit(0.94), 0.68 + 0.04 * F.col("workers") + 0.015 * F.col("responses")), 16, signal_ord=1, evidence=evidence, groups=_strings(F.lit("graph:leader_worker_replies")))
    return shape.union(lead)


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "protocol": protocol,
    "exchange": exchange,
    "artifact_reuse": artifact_reuse,
    "identity_markers": identity_markers,
    "handoffs": handoffs,
    "periodicity": periodicity,
    "benign": benign,
    "opaque_exchange": opaque_exchange,
    "shared_credential": shared_credential,
    "round_the_clock": round_the_clock,
    "shift_coverage": shift_coverage,
    "style_reuse": style_reuse,
    "commit_intervals": commit_intervals,
    "commit_templates": commit_templates,
    "commit_domains": commit_domains,
    "topology": topology,
}

#: The same signals for a scorer, which reads no keys. Those that are only aggregated are left out by Spark itself.
SCORED = REGISTRY | {"protocol": _strongest_protocol, "round_the_clock": partial(round_the_clock, keys=False), "commit_templates": partial(commit_templates, keys=False)}

#: What each detector reads besides cluster_id. A feature that is not read need not be computed.
READS: dict[str, list[str]] = {
    "protocol": ["event_key", *_TIME, "protocol"],
    "exchange": ["event_key", "parent_key", *_TIME, "actor_raw", "conversation_key", "resource_key", "acts", "refs"],
    "artifact_reuse": ["event_key", "actor_key", "conversation_key", "resource_key", "artifacts"],
    "identity_markers": ["event_key", "actor_key", "conversation_key", "resource_key", "identity_markers"],
    "handoffs": ["event_key", "parent_key", *_TIME, "actor_raw", "artifacts"],
    "periodicity": ["event_key", *_TIME],
    "benign": ["event_key", *_TIME, "is_bot", "is_routine", "template"],
    "opaque_exchange": ["event_key", "actor_key", *_TIME, "opaque"],
    "shared_credential": ["event_key", "actor_key", "resource_key", "credentials"],
    "round_the_clock": ["event_key", "actor_key", "resource_key", *_TIME, "is_bot", "words"],
    "shift_coverage": ["event_key", "actor_key", "resource_key", *_TIME, "is_bot"],
    "style_reuse": ["event_key", "actor_key", "structured", "words"],
    "commit_intervals": ["event_key", "actor_key", *_TIME, "is_push"],
    "commit_templates": ["event_key", *_TIME, "is_push", "commit_messages"],
    "commit_domains": ["event_key", "actor_key", "is_push", "email_domains"],
    "topology": ["event_key", "parent_key", "actor_key", "ingest_ord"],
}


def detect(clustered: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Signals of all detectors over clustered observations at rest."""
    out = None
    for find in (registry or REGISTRY).values():
        signals = find(clustered)
        out = signals if out is None else out.unionByName(signals)
    return out
