"""Incremental runs: a stream of raw observations, deduplicated, stored, and analysed cycle by cycle.

Windows are anchored at rows, so a late row can move all that follow it in its bucket. A cycle therefore analyses the
bounded history afresh, and a late row simply joins its cluster; the watermark only bounds the state of deduplication.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import state
from skein.operators.scoring import CalibrationProfile, cluster_facts
from skein.plans import review
from skein.plans.analyze import Analysis, analyze, bundles, summary
from skein.scratch import written
from skein.sources.observations import JSON_RAW, canonical, opened
from skein.store import Store


def observation_stream(spark: SparkSession, path: str, late: str = "24 hours") -> DataFrame:
    """A stream of files of observation JSON, keyed; a key that comes again within the watermark is dropped."""
    raw = opened(spark.readStream.schema(JSON_RAW).json(path))
    keyed = canonical(raw.withColumn("ingest_ord", F.unix_micros("event_time")))
    return keyed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["event_key"])


class Monitor:
    """Stores what comes in, analyses the newest history, and raises at most one pending alert at a time; with a
    ``reviewer``, all reviewable clusters with new evidence, each of which is classified at once so that the watch goes on."""

    def __init__(self, store: Store, threshold: float = 0.75, minutes: int = 1440, history: int = 20_000, on_cycle: Callable[[dict], None] | None = None, calibration: CalibrationProfile | None = None, reviewer: review.BundleReviewer | None = None):
        self.store, self.threshold, self.minutes, self.history, self.on_cycle, self.calibration, self.reviewer = store, threshold, minutes, history, on_cycle, calibration, reviewer

    def cycle(self, batch: DataFrame, batch_id: int) -> dict:
        """One micro-batch; while an alert is pending nothing is collected into new alerts."""
        fresh = written(batch.dropDuplicates(["event_key"]), "batch")
        # A batch that is run again replaces its own rows.
        self.store.observations.put(fresh)
        waiting = self.store.control.pending()
        if waiting and self.reviewer:
            self.review_pending(fresh.sparkSession)
        elif waiting:
            return self._told({"state": "paused", "alert": waiting["id"], "observations": fresh.count()})
        return self._told(self.judge(fresh))

    def judge(self, fresh: DataFrame) -> dict:
        """Analyses the newest history; the best reviewable cluster with evidence in ``fresh`` becomes an alert."""
        control = self.store.control
        held = written(self.store.newest(fresh.sparkSession, self.history), "history")
        done = analyze(held, self.threshold, self.minutes, self.calibration)
        scores = written(done.scores, "scores")
        candidates = state.with_new_evidence(scores.filter("reviewable"), done.clustered, fresh)
        result = {"state": "watching", "observations": fresh.count(), "clusters": scores.count()}
        if self.reviewer and not candidates.isEmpty():
            return result | {"classified": self.classified(done, scores, candidates, held)}
        best = candidates.orderBy(F.desc("score"), "cluster_id").limit(1)
        row = next(iter(best.collect()), None)
        if row is None:
            return result | {"watchlist": [(r["cluster_id"], r["score"]) for r in state.watchlist(scores).collect()]}
        one, alert = self._raised(done, scores, row["cluster_id"])
        chosen = Analysis(done.features, one, done.signals, scores.filter(F.col("cluster_id") == row["cluster_id"]))
        self.store.keep_bundles(bundles(chosen, held), done.signals, cluster_facts(one))
        return result | {"state": "paused" if control.pending() else "watching", "alert": alert}

    def _raised(self, done: Analysis, scores: DataFrame, cluster_id: str) -> tuple[DataFrame, int]:
        """The rows of a cluster and its alert."""
        one = done.clustered.filter(F.col("cluster_id") == cluster_id)
        mark = state.alert_fingerprints(one).first()["fingerprint"]
        return one, self.store.control.raise_alert(mark, cluster_id, summary(scores.filter(F.col("cluster_id") == cluster_id), 1, one)["top_clusters"][0])

    def classified(self, done: Analysis, scores: DataFrame, candidates: DataFrame, held: DataFrame) -> list[dict]:
        """Alerts of all ``candidates``, best first, each with what the reviewer makes of its bundle."""
        own = done.clustered.join(candidates.select("cluster_id"), "cluster_id", "left_semi")
        kept = written(bundles(Analysis(done.features, own, done.signals, candidates), held), "bundles")
        self.store.keep_bundles(kept, done.signals, cluster_facts(own))
        out = []
        for bundle in review.each(kept):
            _, alert = self._raised(done, scores, bundle["cluster_id"])
            waiting = next(a for a in self.store.control.state["alerts"] if a["id"] == alert)["status"] == "pending"
            out += [review.review(self.store.control, alert, bundle, self.reviewer)] if waiting else []
        return out

    def review_pending(self, spark: SparkSession) -> None:
        """Lets the reviewer have what waits, such as an alert that was raised while there was none."""
        while waiting := self.store.control.pending():
            kept = self.store.bundles.rows(spark)
            own = [] if kept is None else list(review.each(kept.filter(F.col("cluster_id") == waiting["cluster_id"])))
            review.review(self.store.control, waiting["id"], own[0] if own else waiting["summary"], self.reviewer)

    def _told(self, result: dict) -> dict:
        if self.on_cycle:
            self.on_cycle(result)
        return result

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Batches without rows only move the watermark; they make no cycle."""
        return stream.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else self.cycle(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
