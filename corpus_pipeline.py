"""From raw documents to packed training sequences, in five stages; each one works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from tidemark.llm.shared import delete, scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents at hand.

    A null or empty text is scored by the bias; rows that repeat share a score. An empty table gives no rows.
    """
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; a null text counts as empty, a null doc_id as smallest.

    Of rows that repeat doc_id and text, one stays. An empty table gives no rows.
    """
    return exact_dedup.distinct_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the smallest doc_id stays; null or wordless texts are alone and stay.

    Rows that repeat that doc_id all stay. An empty table gives no rows.
    """
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or what the mix takes of them, once for each round in which it takes them.

    A text without words gives no row; rows that repeat are documents of their own. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null or empty text has its end id alone.

    Rows that repeat are packed as often. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the permutations; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
        if former:
            delete(spark, former)
        former = path
    return STAGES[-1][1](spark, docs, sf_dir)
