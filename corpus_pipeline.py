"""A training corpus from raw documents: five stages, each an operator of ``tarmac.llm``.

A stage reads all that its predecessor kept, written as Parquet in the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm.common import every, stored, table
from tarmac.llm.decontaminate import without_benchmark
from tarmac.llm.mixing import mixed
from tarmac.llm.quality_model import classify, training_labels
from tarmac.llm.secrets import redacted, scan
from tarmac.llm.simhash import one_per_component


def accepted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = classify(docs, training_labels(table(spark, sf_dir, "labels")))
    return judged.where("predicted = 1").select(*every(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    return one_per_component(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def free_of_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return redacted(docs, scan(docs))


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixed(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", accepted_quality),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", free_of_benchmark),
    ("secret scans", free_of_secrets),
    ("mixing sources", mixed_by_source),
]

# SQL has no counterpart of the classifier and the fingerprints; brute force tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
