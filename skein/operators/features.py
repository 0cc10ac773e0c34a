"""One narrow pass over observations computes every feature that clustering and detectors read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


def with_features(obs: DataFrame) -> DataFrame:
    """``obs`` (canonical) with the features; the text itself is left out, so that later shuffles stay small."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = obs.withColumns(
        {
            "event_key": F.coalesce("event_key", F.concat("source", F.lit(":"), "source_event_id")),
            "actor_raw": F.lower(F.trim("actor")),
            "bucket": F.coalesce("conversation_key", "resource_key", "event_key"),
            "artifacts": X.artifacts(text, F.col("artifact_urls"), F.col("code_blocks"), F.col("context_ids")),
            "cleaned": X.clean_text(text),
            "payloads": X.opaque_payloads(text),
            "scaffold": X.opaque_scaffold(text),
            "all_credentials": X.credentials(text),
            "identity_markers": X.identity_markers(text),
            "words": X.normalize_text(text),
            "structured": X.has(text, X.MARKDOWN_STRUCTURE),
            "protocol": X.protocol_hits(text),
            "is_bot": X.bot_identity(F.col("actor"), F.col("actor_type"), F.col("app_slug")),
            "is_routine": X.routine(F.col("event_type"), text),
            "template": F.when(text != "", X.normalize_template(text)),
            "is_push": F.lower("event_type") == "pushevent",
            "us": F.unix_micros("event_time"),
        }
    )
    out = out.withColumns(
        {
            "opaque": F.filter("payloads", lambda v: ~F.array_contains(F.col("context_ids"), F.lower(v))),
            "any_opaque": F.size("payloads") > 0,
            "acts": X.speech_acts(F.col("cleaned")),
            "refs": X.references(F.col("cleaned")),
            "credentials": F.filter("all_credentials", lambda v: ~F.array_contains(F.col("context_ids"), v)),
        }
    )
    return out.drop("cleaned", "payloads", "text", "code_blocks", "artifact_urls")
