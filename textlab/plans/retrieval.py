"""Whole texts -> stored vectors -> neighbours -> prompts, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textlab.operators.embed import Embedder, embed_missing
from textlab.operators.knn import knn_join
from textlab.operators.prompts import NEIGHBOURS
from textlab.operators.splits import TRAIN, in_split
from textlab.plans.training import labelled_vectors, training_records


def text_neighbours(
    corpus: DataFrame, store: str, embedder: Embedder, k: int = NEIGHBOURS, *, embed_options: dict | None = None, **knn_options
) -> DataFrame:
    """The ``k`` training texts nearest to every text of a split corpus: ``qid, tid, score, rank``.

    ``corpus`` has ``id, text, label, split``.  Texts without a vector in the store are
    embedded first, whole.  A text is never its own neighbour.
    """
    vectors = labelled_vectors(corpus, embed_missing(corpus, store, embedder, **(embed_options or {})))
    return knn_join(vectors, in_split(vectors, TRAIN), k, exclude_self=True, **knn_options)


def retrieval_records(
    corpus: DataFrame, store: str, embedder: Embedder, *, embed_options: dict | None = None, **options
) -> DataFrame:
    """Instruction records of a split corpus from nothing but its texts.

    ``corpus`` has ``id, text, label, split``.  Texts without a vector in the store are
    embedded first; the rest is :func:`textlab.plans.training.training_records`, with its options.
    """
    return training_records(corpus, embed_missing(corpus, store, embedder, **(embed_options or {})), **options)
