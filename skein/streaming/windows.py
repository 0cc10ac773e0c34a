"""Anchored windows kept up to date by keyed state: what comes in touches its own bucket's windows only.

A bucket's open windows are its state, each with its rows' features. A row joins the window that covers it; one that no
window covers opens a window, which takes over the rows of the next that it now covers, and what is left of that opens
windows in turn. Only windows that changed leave the state, whole, so that a batch is analysed without the history. A
window closes, and its rows leave the state, once the watermark has passed its end; rows that come later than the watermark
allows are dropped.

Windows are named by the time that opened them, since a late row may renumber all that follow it; ``WindowTable.numbered``
gives the numbers of the whole history. Links between buckets and long trajectories need other buckets' rows and are left to
``analyze``.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skein.operators.features import with_features
from skein.operators.scoring import CalibrationProfile
from skein.plans.analyze import Analysis, analyze_members
from skein.scratch import written

#: Spark keeps keyed state of this kind in RocksDB only.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGES = "bucket string, opener long, gone boolean, us long, ord long, event_key string, row string"
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class OpenWindows(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "opener long", "rows string")

    def _rows(self, opener: int) -> list[list]:
        return json.loads(self.windows.getValue((opener,))[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        openers = sorted(k[0] for k in self.windows.keys())
        pool = sorted([r["us"], r["ord"], r["event_key"], r["row"]] for r in rows)
        held: dict[int, list[list]] = {}
        gone: set[int] = set()
        while pool:
            first = pool[0][0]
            at = bisect_right(openers, first) - 1
            if at >= 0 and first - openers[at] <= self.size:
                opener = openers[at]
                inside = held.get(opener) or self._rows(opener)
            else:
                opener, inside = first, []
                openers.insert(at + 1, opener)
                if at + 2 < len(openers) and openers[at + 2] - opener <= self.size:
                    # The next window begins within the new one: its rows are dealt anew.
                    next_ = openers.pop(at + 2)
                    pool = sorted(pool + (held.pop(next_, None) or self._rows(next_)))
                    gone.add(next_)
            known = {r[2] for r in inside}
            for r in pool:
                if r[0] - opener > self.size:
                    break
                if r[2] not in known:
                    known.add(r[2])
                    inside.append(r)
            pool = [r for r in pool if r[0] - opener > self.size]
            held[opener] = sorted(inside)
            gone.discard(opener)
        for opener in gone:
            if self.windows.containsKey((opener,)):
                self.windows.removeKey((opener,))
            yield Row(bucket=key[0], opener=opener, gone=True, us=None, ord=None, event_key=None, row=None)
        for opener, inside in held.items():
            if not self.windows.containsKey((opener,)):
                self.handle.registerTimer((opener + self.size) // 1000 + 1)
            self.windows.updateValue((opener,), (json.dumps(inside),))
            for us, ord_, event_key, row in inside:
                yield Row(bucket=key[0], opener=opener, gone=False, us=us, ord=ord_, event_key=event_key, row=row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for opener in [k[0] for k in self.windows.keys()]:
            if (opener + self.size) // 1000 < now:
                self.windows.removeKey((opener,))
        return iter([])

    def close(self) -> None:
        pass


def changed_windows(stream: DataFrame, minutes: int = 60) -> DataFrame:
    """The windows that each batch of canonical observations (with a watermark on event_time) changes: (bucket, opener, gone,
    us, ord, event_key, row); ``row`` holds the features as JSON. A window that is gone has one row."""
    feats = with_features(stream)
    whole = F.to_json(F.struct(*feats.columns), _MICROS).alias("row")
    keyed = feats.select("bucket", "event_time", "us", F.col("ingest_ord").alias("ord"), "event_key", whole)
    return keyed.groupBy("bucket").transformWithState(OpenWindows(minutes * 60_000_000), CHANGES, "update", "eventTime")


class WindowTable:
    """Windows and scores by the batch that changed them last; a batch that is run again replaces itself."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def put(self, kind: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def _latest(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/{kind}")
        last = rows.groupBy("bucket", "opener").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["bucket", "opener", "batch"], "left_semi").drop("batch")

    def members(self, spark: SparkSession) -> DataFrame:
        """(bucket, opener, event_key) of the windows as they are now."""
        return self._latest(spark, "windows").filter("NOT gone").select("bucket", "opener", "event_key")

    def numbered(self, spark: SparkSession) -> DataFrame:
        """(cluster_id, event_key) with windows numbered as in an analysis of the whole history."""
        rows = self.members(spark)
        number = F.row_number().over(Window.partitionBy("bucket").orderBy("opener")) - 1
        names = rows.select("bucket", "opener").distinct().select("bucket", "opener", F.concat("bucket", F.lit(":"), number).alias("cluster_id"))
        return rows.join(names, ["bucket", "opener"]).select("cluster_id", "event_key")

    def scores(self, spark: SparkSession) -> DataFrame:
        """The scores of the windows as they are now."""
        now = self.members(spark).select("bucket", "opener").distinct()
        return self._latest(spark, "scores").join(now, ["bucket", "opener"], "left_semi")


def analysed(changes: DataFrame, schema: StructType, threshold: float, calibration: CalibrationProfile | None = None) -> Analysis:
    """The analysis of the windows of ``changes``, which are all it reads."""
    rows = changes.filter("NOT gone").select(F.concat_ws("@", "bucket", "opener").alias("cluster_id"), F.from_json("row", schema, _MICROS).alias("f"))
    feats = written(rows.select("f.*"), "features")
    return analyze_members(feats, written(rows.select("cluster_id", "f.event_key"), "members"), threshold, calibration)


def start(stream: DataFrame, table: WindowTable, checkpoint: str, minutes: int = 60, threshold: float = 0.60, calibration: CalibrationProfile | None = None, **trigger):
    """Keeps windows and their scores in ``table`` up to date with ``stream``."""
    spark = stream.sparkSession
    for key, value in STATE.items():
        spark.conf.set(key, value)
    schema = with_features(stream).schema

    def batch(changes: DataFrame, n: int) -> None:
        if changes.isEmpty():
            return
        changes = written(changes, "changes")
        table.put("windows", changes.select("bucket", "opener", "gone", "event_key", "us", "ord"), n)
        scores = analysed(changes, schema, threshold, calibration).scores
        named = scores.withColumns({"bucket": F.regexp_extract("cluster_id", "^(.*)@", 1), "opener": F.regexp_extract("cluster_id", "@(-?[0-9]+)$", 1).cast("long")})
        table.put("scores", named, n)

    return changed_windows(stream, minutes).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
