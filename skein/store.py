"""What runs leave behind in one folder: observations, claimed fingerprints, bundles with what scores them, control state.

Tables are Parquet files listed in a log (``skein.history``): a change is seen as a whole or not at all, replaces the rows of
its keys, and made again leaves the table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.history import History
from skein.operators import state
from skein.scratch import written


class Store:
    def __init__(self, root: str):
        self.root = root
        self.control = state.Control(f"{root}/control")
        self.observations = History(f"{root}/observations", "event_key", "event_time")
        self.fingerprints = History(f"{root}/fingerprints", "fingerprint")
        self.bundles = History(f"{root}/bundles", "cluster_id")
        self.signals = History(f"{root}/signals", "cluster_id")
        self.facts = History(f"{root}/facts", "cluster_id")

    def newest(self, spark: SparkSession, n: int) -> DataFrame | None:
        """The newest observations, read from files that can hold them."""
        return self.observations.newest(spark, n)

    def claim(self, found: DataFrame) -> DataFrame:
        """Rows of ``found`` (fingerprint, first_seen, ...) that no run claimed before; they are claimed now."""
        spark = found.sparkSession
        known = self.fingerprints.rows(spark)
        known = found.select("fingerprint").limit(0) if known is None else known.select("fingerprint")
        fresh = written(state.claim_fingerprints(known, found), "claimed")
        if not fresh.isEmpty():
            self.fingerprints.put(fresh.select("fingerprint", "first_seen"))
        return fresh

    def keep_bundles(self, bundles: DataFrame, signals: DataFrame, facts: DataFrame) -> None:
        """Bundles by cluster_id, with the signals and facts that score them again."""
        chosen = bundles.select("cluster_id")
        self.bundles.put(bundles)
        self.signals.put(signals.join(chosen, "cluster_id", "left_semi"))
        self.facts.put(facts.join(chosen, "cluster_id", "left_semi"))

    def health(self) -> dict:
        """From the lists of files and the log alone: no table is read."""
        tables = {name: getattr(self, name) for name in ("observations", "bundles", "fingerprints")}
        oldest, newest = self.observations.span()
        kept = self.control.state
        return {
            "store": self.root,
            "bytes_on_disk": sum(t.bytes() for t in (*tables.values(), self.signals, self.facts)) + self.control.log.files.size(),
            "counts": {name: t.count() for name, t in tables.items()} | {"alerts": len(kept["alerts"]), "partitions": len(kept["partitions"])},
            "oldest_event_time": oldest and str(oldest),
            "newest_event_time": newest and str(newest),
            "pending_alert": self.control.pending() is not None,
        }
