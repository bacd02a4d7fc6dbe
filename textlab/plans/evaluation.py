"""How well does a predictor separate the classes?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from textlab.operators.checks import check_predictions
from textlab.operators.classify import knn_vote
from textlab.operators.embed import Embedder, embed
from textlab.operators.knn import knn_join
from textlab.operators.metrics import metrics_by_source, metrics_by_split
from textlab.operators.splits import TEST, TRAIN, VAL, in_split
from textlab.storage import materialize

# Fixed value: neighbours that vote.
K = 10


def knn_baseline(vectors: DataFrame, *, k: int = K, **knn_options) -> DataFrame:
    """Neighbour-vote metrics on validation and test rows.

    ``vectors`` has ``id, label, split, embedding``; training rows vote.  A split without
    rows has no row in the result.
    """
    queries = in_split(vectors, VAL, TEST)
    neighbours = knn_join(queries, in_split(vectors, TRAIN), k, carry=["label"], **knn_options)
    voted = knn_vote(queries, neighbours)
    return metrics_by_split(queries.select("id", "label", "split").join(voted, "id"), k)


def knn_predictor(
    train: DataFrame, embedder: Embedder, *, k: int = K, embed_options: dict | None = None, **knn_options
) -> Callable[[DataFrame], DataFrame]:
    """A predictor for new texts: embed them, let the nearest rows of ``train`` vote."""

    def predictor(records: DataFrame) -> DataFrame:
        queries = materialize(embed(records, embedder, **{"batched": True, **(embed_options or {})}), "queries")
        neighbours = knn_join(queries, train, k, carry=["label"], **knn_options)
        return knn_vote(queries, neighbours).select("id", "prediction", "confidence")

    return predictor


def evaluate(
    predictor: Callable[[DataFrame], DataFrame], records: DataFrame, *, source: str = "source_model", **options
) -> DataFrame:
    """Overall and per-source metrics of a predictor on labelled records.

    Fails if the predictions do not match the records one to one.  The predictions are
    stored first: they may be costly, and check and metrics both read them.
    """
    predictions = materialize(predictor(records), "predictions")
    found = check_predictions(records, predictions).first()
    if not found["ok"]:
        raise ValueError(f"predictions do not match the records: {found.asDict()}")
    truth = records.select("id", "label", source)
    return metrics_by_source(truth.join(predictions, "id"), source, **options)
