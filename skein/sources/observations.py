"""The canonical observation table: schema, derived keys, and the readers of observations.

Metadata is an open JSON object. The keys that the analysis reads are columns of their own; all keys travel in
``metadata_json``, sorted, in the form that Spark's variants have as JSON (numbers without trailing zeros).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())
_META_TEXT = ["origin_source", "campaign_source", "actor_type", "github_app_slug"]
#: Identifiers of the event itself, which are no evidence when they appear in its text.
CONTEXT_KEYS = ["sha", "commit_sha", "head_sha", "event_id", "node_id", "check_run_id", "workflow_run_id", "installation_id"]

METADATA = T.StructType([T.StructField(k, _S) for k in _META_TEXT + CONTEXT_KEYS] + [T.StructField(k, _A) for k in ("commit_messages", "author_email_domains")])
PROVENANCE = T.StructType([T.StructField("url", _S), T.StructField("retrieval_method", _S), T.StructField("retrieved_at", T.TimestampType())])
RAW = T.StructType(
    [T.StructField(k, _S) for k in ("source", "source_event_id", "event_key")]
    + [T.StructField(k, T.TimestampType()) for k in ("observed_at", "event_time")]
    + [T.StructField(k, _S) for k in ("actor", "platform", "actor_key", "event_type", "text", "repository", "resource_key", "thread_id", "conversation_key", "reply_to", "parent_key")]
    + [T.StructField("artifact_urls", _A), T.StructField("code_blocks", _A), T.StructField("content_sha256", _S), T.StructField("metadata", METADATA), T.StructField("provenance", PROVENANCE)]
)
#: As it stands in JSON lines: the metadata as one piece of text, whatever its keys.
JSON_RAW = T.StructType([T.StructField(f.name, _S if f.name == "metadata" else f.dataType) for f in RAW])
REQUIRED = ["source", "source_event_id", "observed_at", "event_time", "actor", "event_type"]
# Sources that name the code host by another name.
HOST_SOURCES, HOST_CAMPAIGNS = ["gharchive", "grepapp"], ["github-thread", "github-code", "grep"]


def _set(c: Column) -> Column:
    """Null for an empty string, which counts as absent."""
    return F.nullif(c, F.lit(""))


def infer_platform(source: Column, campaign: Column) -> Column:
    low = F.lower(source)
    host = low.contains("github") | low.isin(HOST_SOURCES) | F.lower(F.coalesce(campaign, F.lit(""))).isin(HOST_CAMPAIGNS)
    return F.when(host, F.lit("github")).otherwise(low)


def derive_keys(df: DataFrame) -> DataFrame:
    """Namespaced keys where they are not given, each from those before it."""
    meta = lambda k: F.col(f"metadata.{k}")
    df = df.withColumn("platform", F.coalesce(_set(F.col("platform")), infer_platform(F.coalesce(_set(meta("origin_source")), F.col("source")), meta("campaign_source"))))
    df = df.withColumns(
        {
            "actor_key": F.coalesce(_set(F.col("actor_key")), F.concat("platform", F.lit(":actor:"), F.lower("actor"))),
            "event_key": F.coalesce(_set(F.col("event_key")), F.concat("platform", F.lit(":event:"), "source", F.lit(":"), "source_event_id")),
            "resource_key": F.coalesce(_set(F.col("resource_key")), F.concat("platform", F.lit(":repository:"), F.lower(_set(F.col("repository"))))),
            "parent_key": F.coalesce(_set(F.col("parent_key")), F.concat("platform", F.lit(":event:"), "source", F.lit(":"), _set(F.col("reply_to")))),
        }
    )
    return df.withColumn("conversation_key", F.coalesce(_set(F.col("conversation_key")), F.concat("resource_key", F.lit(":thread:"), _set(F.col("thread_id")))))


def sorted_json(text: Column) -> Column:
    """A JSON object with its keys in order; one that is no variant, as with a key twice, stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def opened(raw: DataFrame) -> DataFrame:
    """Rows of JSON_RAW with the keys that are read in ``metadata`` and the whole in ``metadata_text``."""
    wrong = F.col("metadata").isNotNull() & ~F.ltrim("metadata").startswith("{")
    whole = F.when(wrong, F.raise_error(F.lit("metadata must be an object"))).otherwise(F.col("metadata"))
    return raw.withColumn("metadata_text", whole).withColumn("metadata", F.from_json("metadata_text", METADATA))


def canonical(df: DataFrame) -> DataFrame:
    """Keys, flattened metadata and provenance, and the input order that breaks ties of time."""
    df = derive_keys(df)
    whole = F.col("metadata_text") if "metadata_text" in df.columns else F.to_json("metadata")
    context = F.filter(F.array(*[F.lower(F.col(f"metadata.{k}")) for k in CONTEXT_KEYS]), lambda x: x.isNotNull())
    out = df.select(
        *[f.name for f in RAW if f.name not in ("metadata", "provenance")],
        F.col("metadata.actor_type").alias("actor_type"),
        F.col("metadata.github_app_slug").alias("app_slug"),
        context.alias("context_ids"),
        F.coalesce(F.col("metadata.commit_messages"), F.array().cast("array<string>")).alias("commit_messages"),
        F.coalesce(F.col("metadata.author_email_domains"), F.array().cast("array<string>")).alias("email_domains"),
        F.col("provenance.url").alias("provenance_url"),
        F.coalesce(sorted_json(whole), F.lit("{}")).alias("metadata_json"),
        *[c for c in ("ingest_ord",) if c in df.columns],
    )
    return out if "ingest_ord" in df.columns else out.withColumn("ingest_ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One validated observation for each line; a malformed line or a missing required field stops the job when read."""
    raw = opened(spark.read.schema(JSON_RAW).option("mode", "FAILFAST").json(path))
    for name in REQUIRED:
        raw = raw.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"observation without {name}")).cast(JSON_RAW[name].dataType)))
    return canonical(raw)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_jsonl``; a source_event_id that occurs twice is an error."""
    df = read_jsonl(spark, path)
    twice = df.groupBy("source_event_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate source_event_id: {twice[0][0]}")
    return df


def write_parquet(observations: DataFrame, path: str) -> None:
    """The 13 columns that are kept at rest, compressed with ZSTD."""
    kept = ["event_key", "source", "source_event_id", "platform", "event_time", "actor_key", "event_type", "repository", "conversation_key", "text", "content_sha256", "metadata_json", "provenance_url"]
    observations.select(*kept).write.mode("overwrite").option("compression", "zstd").parquet(path)
