"""A training corpus from ``documents``: toxic texts go, then copies, near copies and recurring passages, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, further columns included. In every stage null text
counts as empty and is no copy of anything but in exact dedup; texts of any length are taken whole; an empty table gives no
rows; what ties and rows that repeat mean is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import labels, shared_path, small_batches
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.llm.substring_dedup import drop_repeated_passages
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is likelier toxic than not go; rows that repeat stay or go together."""
    return drop_toxic(docs, labels(small_batches(spark), sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id stays; one row of it if it repeats."""
    small_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest id stays.

    The SimHash grid and MinHash buckets propose links, and all of them are verified by the whole sets. Null ids stay.
    """
    small_batches(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 35 words that also starts elsewhere are cut out; other texts stay as they are, null included."""
    small_batches(spark)
    return drop_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; rows that repeat are packed each."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: A learned classifier and token ids have no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
