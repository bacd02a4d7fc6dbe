"""Shortest-pack-first packing over the histogram of piece lengths.

Documents are encoded, ended and cut into pieces of at most a sequence.  Only the histogram
of piece lengths (one count per length) is packed: lengths are placed longest first, each
into the kind of pack that is shortest up to now, if it has room (or, with
``longest_pack=True``, the longest that has), and packs of a kind are counted, never listed.
The packing patterns are then joined back to the pieces by rank: the r-th piece of a length
goes into the slot that holds rank r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textlab.llm.batches import slices, worker_state
from textlab.llm.tokens import WordEncoder
from textlab.storage import materialize

#: Ids in a sequence.
SEQUENCE = 1024
#: Words that a worker remembers, as in the encoder, but half as many again: encoding is nearly all of the work.
CACHE_WORDS = 300_000


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE, longest_pack: bool = False) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of packs, lengths in them), longest lengths first.

    Every piece lies in exactly one pack, no pack exceeds ``size``.  The number of patterns
    depends on the lengths that occur, not on how many pieces there are.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = {}  # by space left
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            rooms = range(length, size) if longest_pack else range(size - 1, length - 1, -1)
            room = next((r for r in rooms if open_packs.get(r)), None)
            if room is None:
                # New packs take as many pieces of this length as fit.
                per = size // length
                if packs := left // per:
                    open_packs.setdefault(size - per * length, []).append((packs, [length] * per))
                if rest := left % per:
                    open_packs.setdefault(size - rest * length, []).append((1, [length] * rest))
                break
            packs, lengths = open_packs[room].pop()
            used = min(packs, left)
            if packs > used:
                open_packs[room].append((packs - used, lengths))
            open_packs.setdefault(room - length, []).append((used, [*lengths, length]))
            left -= used
    return [pattern for room in sorted(open_packs) for pattern in open_packs[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Where ranks go: rows of (length, first rank, first sequence, offset), in that order.

    Ranks of a length fill its slots one after another; the n-th rank of a slot goes into
    the n-th sequence of its pattern.
    """
    rows, taken, sequence = [], {}, 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + packs
            offset += length
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int,
    size: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as pieces of at most ``size`` ids: ``_id, start, length, ids, doc_tokens``.

    ``_task`` and ``_place`` (how many pieces of the same length the task has made before)
    number the pieces of a length.  The result is stored, so they are fixed.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, _task bigint, _place bigint"
    return materialize(source.mapInArrow(_cutter(tokenizer, end_id, size), schema), "pieces")


def _cutter(tokenizer: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"pieces-{tokenizer}", lambda: WordEncoder(tokenizer, False, CACHE_WORDS, added_tokens=True))
        task = TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        made = [0] * (size + 1)
        for rows in slices(batches):
            place, out = [], []
            for row, text in enumerate(rows.column("_text").to_pylist()):
                data = encoder.encode(text) + end
                total = len(data) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    place.append(row)
                    out.append((start, length, data[4 * start : 4 * (start + length)], total, task, made[length]))
                    made[length] += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id").take(pa.array(place, pa.int64()))]
                + [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                ["_id", "start", "length", "ids", "doc_tokens", "_task", "_place"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int,
    size: int = SEQUENCE,
    longest_pack: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit.  Null and empty texts are their end id alone;
    rows that repeat an id are packed as documents of their own; an empty table gives no
    rows.  Sequences are numbered from 0 and filled from offset 0 without gaps.
    ``longest_pack`` fills the fullest pack that has room first, which leaves a little less padding.

    Only counts leave the tasks before the last step: one per length for the driver (at most
    ``size`` rows) and one per task and length for the ranks.
    """
    pieces = token_pieces(docs, tokenizer, end_id=end_id, size=size, id_col=id_col, text_col=text_col)
    counts = materialize(pieces.groupBy("length", "_task").agg(F.count("*").alias("_count")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_count")).collect()}
    table = slots(pack_histogram(histogram, size, longest_pack))
    # A window per length over tasks: a thousandth of the counts each.
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "_task", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before")
    )
    ranked = pieces.join(offsets, ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    # Only lengths and ranks go through Python; ids stay where they are.
    placed = ranked.withColumn("_at", _placer(table)("length", "_rank"))
    return placed.select(
        F.col("_id").alias(id_col), "start", "length", "ids", "doc_tokens", "_at.sequence_id", "_at.offset"
    )


def _placer(table: np.ndarray):
    """Looks ranks up in the slots; at most a few slots per length and pattern are shipped."""

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        bounds = np.searchsorted(table[:, 0], np.arange(table[:, 0].max(initial=0) + 2))
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(ranks), np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            lo, hi = bounds[n], bounds[n + 1]
            at[own] = lo + np.searchsorted(table[lo:hi, 1], ranks[own], "right") - 1
        found = table[at]
        columns = [pa.array(found[:, 2] + ranks - found[:, 1]), pa.array(np.ascontiguousarray(found[:, 3]))]
        return pa.StructArray.from_arrays(columns, ["sequence_id", "offset"])

    return F.arrow_udf(place, "sequence_id bigint, offset bigint")
