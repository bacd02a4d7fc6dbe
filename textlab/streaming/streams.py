"""Incremental forms: normalize, embed, score, split, number and evaluate rows as they arrive.

Each returns a started query.  With the default trigger it works off what is there and
ends; the checkpoint makes the next run take only what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.candidates import CandidateStore, prepared
from textlab.operators.classify import knn_vote
from textlab.operators.embed import Embedder, embed
from textlab.operators.increments import GrowingIds, GrowingMetrics, GrowingSplit
from textlab.operators.knn import BROADCAST_BYTES
from textlab.operators.normalize import accepted, align_social
from textlab.storage import materialize

NOW = {"availableNow": True}


def _to_parquet(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def stream_normalize(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    *,
    align: Callable[..., DataFrame] = align_social,
    keep: tuple[str, ...] = (),
    trigger: dict = NOW,
    **options,
) -> StreamingQuery:
    """Normalize arriving raw rows into a corpus table; stateless."""
    return _to_parquet(accepted(align(raw, keep=keep, **options), keep), path, checkpoint, trigger)


def stream_embed(
    rows: DataFrame, embedder: Embedder, path: str, checkpoint: str, *, trigger: dict = NOW, **options
) -> StreamingQuery:
    """Embed arriving ``id, text`` rows; finished files are never embedded again."""
    return _to_parquet(embed(rows, embedder, **{"batched": True, **options}), path, checkpoint, trigger)


def stream_score(
    queries: DataFrame,
    train: DataFrame | CandidateStore,
    path: str,
    checkpoint: str,
    *,
    k: int = 10,
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    trigger: dict = NOW,
) -> StreamingQuery:
    """Classify arriving ``id, embedding`` rows by a vote of a labelled table.

    A table is measured, and shipped or stored by cell, before the stream begins, not for
    each micro-batch.  A store (which carries ``label``) is searched with whatever has been
    added to it by then.

    Every micro-batch writes the folder ``batch_id=N`` of ``path``, so the layout and the
    columns (``batch_id`` among them) are the same whatever the size of ``train``, which may
    grow between two runs on one checkpoint.  A batch that is repeated after a failure
    overwrites its own folder, so its rows are there once.

    A micro-batch is stored once, as the search reads it several times: what stands upstream
    (an embedder, say) runs once for each row.
    """

    search = prepared(train, k, vector=vector, carry=["label"], broadcast_bytes=broadcast_bytes)

    def score(batch: DataFrame, batch_id: int) -> None:
        stored = materialize(batch.select("id", vector), "arrived")
        knn_vote(stored, search(stored)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        queries.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _each_batch(rows: DataFrame, add: Callable[[DataFrame, str], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    """Hand every micro-batch over under its number, so that a repeated one is known."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # Read several times below; what stands upstream runs once.
        add(materialize(batch, "arrived"), str(batch_id))

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_split(rows: DataFrame, split: GrowingSplit, checkpoint: str, *, trigger: dict = NOW) -> StreamingQuery:
    """Take arriving ``id, label`` rows into a split; ``split.assign`` then gives the split of the union."""
    return _each_batch(rows.select("id", "label"), split.add, checkpoint, trigger)


def stream_ids(
    rows: DataFrame, ids: GrowingIds, checkpoint: str, *, order_by: list[str] | None = None, trigger: dict = NOW
) -> StreamingQuery:
    """Number arriving rows densely, each exactly once."""
    return _each_batch(rows, lambda batch, name: ids.add(batch, name, order_by), checkpoint, trigger)


def stream_metrics(predictions: DataFrame, state: GrowingMetrics, checkpoint: str, *, trigger: dict = NOW) -> StreamingQuery:
    """Take arriving predictions into the metrics; earlier ones are never read again."""
    return _each_batch(predictions, state.add, checkpoint, trigger)
