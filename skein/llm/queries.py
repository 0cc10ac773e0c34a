"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bitslice, decontaminate, filter_audit, hmm, lang_id, license_scan, media, merkle, mixing, near_dup, packing, sharding, url_filter
from skein.scratch import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op2_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_rows(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses_of_documents(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lang_id.language_of_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media.text_features(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs_of_documents(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_hmm": op1_hmm,
    "op2_bitslice": op2_bitslice,
    "op3_license_scan": op3_license_scan,
    "op4_mix": op4_mix,
    "op5_pack": op5_pack,
    "op6_shard": op6_shard,
    "op7_lang_id": op7_lang_id,
    "op8_url_filter": op8_url_filter,
    "op9_media": op9_media,
    "op10_near_dup": op10_near_dup,
    "op11_merkle": op11_merkle,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontaminate": op13_decontaminate,
}
ORACLES: dict[str, str] = {"op2_bitslice": bitslice.ORACLE, "op3_license_scan": license_scan.ORACLE, "op8_url_filter": url_filter.ORACLE, "op10_near_dup": near_dup.ORACLE, "op11_merkle": merkle.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_decontaminate": decontaminate.ORACLE}
