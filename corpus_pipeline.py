"""From raw documents to packed training sequences: five stages, each over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import contamination, minmax, packing, queries, recipes, resampling
from textlab.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling rejects."""
    return resampling.keep_quality(docs, queries.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts keep the row with the largest id."""
    return recipes.keep_last_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: four fifths of their shingles of five words."""
    # Bands of 5 values: a pair at the threshold is missed with probability (1 - 0.8 ** 5) ** 34 = 1.4e-6.
    return minmax.keep_one_of_each(docs, words=5, percent=80, band=5, count=34)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text."""
    return contamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    packed = packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=0)
    return queries.packed_digest(packed)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", pack)]

# The quality models, the tokenizer and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
