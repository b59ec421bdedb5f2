"""A corpus from raw documents to packed sequences: each stage reads what its predecessor left and writes Parquet."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barflow.llm import cascade, crf, packing, superminhash, tree_dedup
from barflow.llm.queries import table, vocabulary
from barflow.operators.stage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return cascade.accepted(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good. The model is fitted on labelled rows of the raw table, where bad ones are still there to learn from."""
    return crf.accepted(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones."""
    return tree_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return superminhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all training sequences."""
    return packing.packed(docs, vocabulary(), end_id=2)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: The classifier and the packing have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
