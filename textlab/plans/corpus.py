"""Raw files -> corpus with ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.operators.checks import require_rows
from textlab.operators.normalize import (
    CORPUS_FIELDS,
    accepted,
    align_adversarial,
    align_social,
    combine,
    explode_answers,
)
from textlab.operators.ranks import dense_ids
from textlab.sources.readers import ORDER_COLUMNS, read_answers, read_csv, read_csv_folder

_SORT_KEY = ("_source", *ORDER_COLUMNS, "answer_pos")


def build_corpus(
    spark: SparkSession, social_folder: str, answers_path: str, *, multiline: bool = True, ordered: bool = True
) -> DataFrame:
    """Social files in path order, then answer records, numbered from 0 in that order.

    ``ordered=False`` numbers the rows as the tasks read them and saves the sort: ids are
    dense and, once given, fixed, but follow no stated order.
    """
    order = list(ORDER_COLUMNS)
    parts = [
        accepted(align_social(table, keep=order), keep=order)
        .withColumn("_source", F.lit(0))
        .withColumn("answer_pos", F.lit(0))
        for table in read_csv_folder(spark, social_folder, multiline=multiline)
    ]
    parts.append(explode_answers(read_answers(spark, answers_path), keep=order).withColumn("_source", F.lit(1)))
    numbered = dense_ids(combine(*parts), order_by=list(_SORT_KEY) if ordered else None)
    return require_rows(numbered.select("id", *CORPUS_FIELDS), "no corpus records found")


def build_adversarial(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame | None:
    """The adversarial evaluation set with ids of its own, or None if the file is absent."""
    raw = read_csv(spark, path, multiline=multiline)
    if raw is None:
        return None
    order = list(ORDER_COLUMNS)
    rows = accepted(align_adversarial(raw, keep=order), keep=order)
    return dense_ids(rows, order_by=order).select("id", *CORPUS_FIELDS)
