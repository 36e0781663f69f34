"""Corpus pipeline: toxicity filter, near-duplicate removal, substring deduplication, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozlab.llm import common, neardup, packing, substrings, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not predict to be toxic."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id."""
    common.bounded_batches(spark)
    return neardup.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier document holds; n_chars follows the text."""
    common.bounded_batches(spark)
    return substrings.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences of at most 1024 tokens."""
    common.bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, tail=(2,))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL cannot express the trained model, the near-duplicate components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
