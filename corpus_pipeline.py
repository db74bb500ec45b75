"""A training-data pipeline over ``documents``: quality rules, toxicity, near-duplicates, packing.

Each stage takes all that its predecessor kept and decides for good.  Every stage but the last returns whole rows of
documents with all their columns; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinspark.llm.minhash import NearDuplicates, keep_one
from clinspark.llm.packing import Packing, pack
from clinspark.llm.quality import fit_quality, keep_good
from clinspark.llm.queries import END_ID, WORD_TOKENIZER
from clinspark.llm.text import table, tuned
from clinspark.llm.toxicity import fit_toxicity, keep_clean, training_labels
from clinspark.session import stage_table

# SQL cannot express the fitted stages.  Their operators have tests of their own; run() as a whole has none yet.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the trees reject; the trees learn from the labelled rows of ``documents``."""
    documents, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return keep_good(docs, fit_quality(documents, labels))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic; the model learns from the training fold of the labels of ``documents``."""
    documents, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return keep_clean(docs, fit_toxicity(documents, training_labels(labels)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 of their five-word shingles."""
    tuned(spark)
    return keep_one(docs, NearDuplicates(words=5, percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left."""
    tuned(spark)
    packed = pack(docs, Packing(WORD_TOKENIZER, END_ID))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
