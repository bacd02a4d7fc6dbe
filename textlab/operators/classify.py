"""Predictors: neighbour vote, random baseline, and any per-batch callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.labels import AI, HUMAN, UNKNOWN_SOURCE, is_ai
from textlab.functions.text import hash_uniform, seeded_hash

PREDICTION_SCHEMA = "prediction STRING, confidence DOUBLE"


def vote_counts(neighbours: DataFrame, label: str = "label") -> DataFrame:
    """Votes per query: ``qid, ai_votes, total_votes``."""
    return neighbours.groupBy("qid").agg(
        F.sum(is_ai(F.col(label)).cast("bigint")).alias("ai_votes"), F.count("*").alias("total_votes")
    )


def _confidence(ai_votes: Column, total_votes: Column) -> Column:
    return F.when(total_votes > 0, ai_votes / total_votes).otherwise(F.lit(0.5))


def _verdict(ai_votes: Column, total_votes: Column) -> Column:
    return F.when(ai_votes >= total_votes - ai_votes, AI).otherwise(HUMAN)


def knn_vote(queries: DataFrame, neighbours: DataFrame, query_id: str = "id", label: str = "label") -> DataFrame:
    """Majority vote of the neighbours: ``id, ai_votes, total_votes, prediction, confidence``.

    A tie, and a query without any neighbour, goes to ai; the latter with confidence 0.5.
    """
    votes = vote_counts(neighbours, label)
    ai = F.coalesce(F.col("ai_votes"), F.lit(0))
    total = F.coalesce(F.col("total_votes"), F.lit(0))
    return (
        queries.select(F.col(query_id).alias("id"))
        .join(votes.withColumnRenamed("qid", "id"), "id", "left")
        .select(
            "id",
            ai.alias("ai_votes"),
            total.alias("total_votes"),
            _verdict(ai, total).alias("prediction"),
            _confidence(ai, total).alias("confidence"),
        )
    )


def _for_each(found: DataFrame, queries: DataFrame | None, query_id: str) -> DataFrame:
    """Results by ``qid``, with a row of nulls for queries that have none."""
    if queries is None:
        return found
    return queries.select(F.col(query_id).alias("qid")).join(found, "qid", "left")


def knn_evidence(
    neighbours: DataFrame, label: str = "label", queries: DataFrame | None = None, query_id: str = "id"
) -> DataFrame:
    """Verdict, confidence and the neighbours behind it, at most k per query.

    Given ``queries``, those without any neighbour are there too: ai with confidence 0.5 and
    no evidence.
    """
    ai_votes = F.coalesce(F.col("ai_votes"), F.lit(0))
    total = F.coalesce(F.col("total_votes"), F.lit(0))
    item = F.struct("rank", "tid", F.col("score").alias("score"), F.col(label).alias("label"))
    summary = F.concat(
        total.cast("string"), F.lit(" similar texts found, "), ai_votes.cast("string"), F.lit(" were AI-generated")
    )
    votes = neighbours.groupBy("qid").agg(
        F.sum(is_ai(F.col(label)).cast("bigint")).alias("ai_votes"),
        F.count("*").alias("total_votes"),
        F.array_sort(F.collect_list(item)).alias("evidence"),
    )
    none = F.array().cast(votes.schema["evidence"].dataType)
    return (
        _for_each(votes, queries, query_id)
        .select(
            "qid",
            F.when(_verdict(ai_votes, total) == AI, "AI-generated").otherwise("Human-written").alias("verdict"),
            _confidence(ai_votes, total).alias("confidence"),
            summary.alias("summary"),
            F.coalesce("evidence", none).alias("evidence"),
        )
    )


def knn_attribution(
    neighbours: DataFrame,
    source: str = "source_model",
    queries: DataFrame | None = None,
    query_id: str = "id",
) -> DataFrame:
    """The neighbours' most common generator: ``qid, source_model, n``; ties by name.

    Given ``queries``, those without any neighbour have a null generator and 0.
    """
    counts = neighbours.groupBy("qid", F.coalesce(F.col(source), F.lit(UNKNOWN_SOURCE)).alias("source_model")).agg(
        F.count("*").alias("n")
    )
    best = Window.partitionBy("qid").orderBy(F.desc("n"), "source_model")
    found = counts.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") == 1).drop("_place")
    return _for_each(found, queries, query_id).withColumn("n", F.coalesce("n", F.lit(0)))


def random_baseline(records: DataFrame, seed: int = 42) -> DataFrame:
    """A coin flip per record with confidence in 0.3..0.7, mirrored for human.

    Drawn from a hash of the id, so it does not depend on row order or partitioning.
    """
    digest = F.col("_digest")
    flip, spread = hash_uniform(digest, 1), hash_uniform(digest, 9)
    confidence = F.lit(0.3) + F.lit(0.4) * spread
    says_ai = flip < 0.5
    return records.select("id", seeded_hash(F.col("id"), seed).alias("_digest")).select(
        "id",
        F.when(says_ai, AI).otherwise(HUMAN).alias("prediction"),
        F.when(says_ai, confidence).otherwise(F.lit(1.0) - confidence).alias("confidence"),
    )


def batch_predictor(
    predict: Callable[[list[str]], Sequence[dict]], batch_size: int = 1000
) -> Callable[[DataFrame], DataFrame]:
    """Turn ``predict(texts) -> [{"prediction", "confidence"}, ...]`` into a DataFrame predictor.

    The callable runs in the tasks, on ``batch_size`` texts at a time, and has to give one
    answer per text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                answers = predict(part["text"].tolist())
                if len(answers) != len(part):
                    raise ValueError(f"predictor gave {len(answers)} answers for {len(part)} texts")
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "prediction": [a["prediction"] for a in answers],
                        "confidence": [float(a["confidence"]) for a in answers],
                    }
                )

    def predictor(records: DataFrame) -> DataFrame:
        kind = records.schema["id"].dataType.simpleString()
        return records.select("id", "text").mapInPandas(run, f"id {kind}, {PREDICTION_SCHEMA}")

    return predictor
