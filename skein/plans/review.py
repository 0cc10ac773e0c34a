"""Automated reviewers of bundles: anything that takes a bundle and gives a classification. None is built in."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame

from skein.operators.state import Control

# The fields of a classification that findings show, with what stands for one that is not given.
FIELDS = {
    "classification": "inconclusive",
    "autonomy_level": "unknown",
    "confidence": "low",
    "summary": "",
    "intent": "",
    "human_risk": "",
    "company_affiliation": "",
    "agents_identified": [],
    "models_identified": [],
    "evidence_for": [],
    "evidence_against": [],
    "recommended_disposition": "manual_review",
}


class BundleReviewer(Protocol):
    name: str
    model: str | None

    def classify(self, bundle: dict) -> dict:
        """A classification of a bundle (``analyze.bundles`` as a dict); what it raises is kept as a failed one."""
        ...


def review(control: Control, alert_id: int, bundle: dict, reviewer: BundleReviewer, at: datetime | None = None) -> dict:
    """Lets ``reviewer`` classify a pending alert and closes it. A reviewer that fails does not stop the watch: the alert is
    closed as such, with its evidence kept, and may be classified again by hand."""
    try:
        found, status = FIELDS | reviewer.classify(bundle), "reviewed"
    except Exception as e:  # whatever a reviewer raises
        why = f"{type(e).__name__}: the reviewer failed"
        found, status = FIELDS | {"classification": "classifier_error", "confidence": "none", "evidence_against": [why], "recommended_disposition": "retry_classification"}, "classification-error"
    control.review(alert_id, {"classification": found, "reviewer": reviewer.name, "model": reviewer.model, "classification_created_at": (at or datetime.now(UTC)).isoformat()})
    control.resolve(alert_id, status)
    return {"id": alert_id, "status": status, "classification": found}


def each(bundles: DataFrame) -> Iterator[dict]:
    """Bundles from the highest score, one in memory at a time."""
    for row in bundles.orderBy(bundles["score"].desc(), "cluster_id").toLocalIterator():
        yield row.asDict(recursive=True)
