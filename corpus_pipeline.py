"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``: the
first two drop rows, the third repeats or drops rows by their mixing rate, and the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm import lang_id, mixing, near_dup, packing
from skein.scratch import small_batches, table, written

#: A document stays if all learned languages together have at least this mean probability (and it has a letter at all).
#: On sf0.1, the least of 2,499 held-out documents had 0.24, half of them over 0.98; random letters, keys, base64, code and
#: texts of other scripts or of a language that was not learned had at most 0.02.
LEAST_LANGUAGE_SHARE = 0.1
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without texts in none of the learned languages.

    Null, empty and letterless texts go, and all texts if no row is labelled. Repeated rows fare alike. Columns of any
    name are kept. An empty table stays empty.
    """
    small_batches(spark)
    return lang_id.keep_identified(docs, LEAST_LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, its smallest doc_id.

    Texts without words are no duplicates and stay; rows without doc_id stay; of rows that share a doc_id the least by
    their texts' hash and their other columns stays. Columns of any name are kept. An empty table stays empty.
    """
    small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every row as often as its rate says (0 times and more), so that the domains' tokens meet the targets.

    Null and wordless texts have the prior's rate; rows without doc_id are drawn alike; repeated rows each have copies of
    their own. Columns of any name are kept. An empty table stays empty, and without labels all rows stay.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of ``docs``, each a sequence; other columns than the text and its id are not carried.

    A null or empty text is its end id alone; a null id is kept; repeated rows (copies) are packed once each. An empty table
    gives no pieces.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Learned models and a tokenizer decide these rows; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
