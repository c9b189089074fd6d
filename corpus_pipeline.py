"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); all but the last return documents with their columns. A stage's
result is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codefacts.llm import lsm_dedup, ordinal_quality, residual_packing, simhash_copies, toxicity_knn
from codefacts.llm.common import saved, table

#: Not expressible in SQL: fitted models, fingerprints, components, packing.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity_knn.civil(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather poor go."""
    return ordinal_quality.selected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    return lsm_dedup.Index(docs).kept_rows()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a five-word similarity of 0.8 and more, directly or through others, the one with the smallest id stays."""
    return simhash_copies.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and offset."""
    return residual_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
