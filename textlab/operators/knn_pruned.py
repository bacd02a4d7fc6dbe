"""Exact cosine top-k join that skips groups of candidates which cannot matter.

1. A few candidates serve as pivots.  Every candidate joins the group (cell) of its nearest
   pivot; a cell is described by the range of angles between its pivot and its members.
2. Each query is searched in the nearest cells that together hold k candidates.  The k-th
   score found there is a bar that any further neighbour has to reach.
3. Angles obey the triangle inequality, so the angle between query and pivot and the range of
   the cell bound the best score the cell can offer.  The query is scored in the cells whose
   bound reaches its bar, and in no others.

Neighbouring cells travel as one bundle of about a block, so a query is laid out once for each
bundle that holds a cell it wants, never once for each cell.  Which cells those are is worked out
again where query and bundle meet.

Nothing is left out: a cell is skipped only if its bound proves that it cannot contribute.
Cells of any size are cut into blocks, so a cell that holds a third of all candidates, or is
asked by a third of all queries, is many block pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textlab.functions.text import seeded_hash
from textlab.operators.knn import _matrix, _result_schema, _unit, grid, grid_rows, merge_top_k
from textlab.storage import materialize

# Bounds the pivot matrix, the cell table and the work of locating a vector.
MAX_PIVOTS = 2048
DRAWN_PER_PIVOT = 8
# Rows handed over at once when a query goes to many cells.
SENT_ROWS = 4096
# Added to every angle bound: covers the rounding of arccos many times over.
SLACK = 1e-6
# Cell of vectors without a direction, which score 0 with everything.
NO_DIRECTION = -1


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def choose_pivots(train: DataFrame, train_id: str, vector: str, n_train: int) -> np.ndarray:
    """Up to ``MAX_PIVOTS`` directions that lie far apart, from a bounded draw by hash of the id.

    Each further pivot is the drawn vector farthest from those chosen, so every cluster of
    some size gets one and cells stay narrow.
    """
    wanted = min(MAX_PIVOTS, max(1, math.isqrt(n_train)))
    drawn = train.select(vector, seeded_hash(F.col(train_id), 0).alias("_h"))
    drawn = drawn.orderBy("_h").limit(wanted * DRAWN_PER_PIVOT).select(vector).toArrow()
    unit = _unit(_matrix(drawn.column(0)))
    unit = np.unique(unit[(unit != 0).any(axis=1)], axis=0)
    if len(unit) == 0:
        return unit
    chosen, closest = [0], unit @ unit[0]
    while len(chosen) < min(wanted, len(unit)):
        chosen.append(int(closest.argmin()))
        np.maximum(closest, unit @ unit[chosen[-1]], out=closest)
    return unit[chosen]


def locate(train: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """Add ``_cell``, the nearest pivot, and ``_angle``, the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(vector)))
            cell = np.full(len(unit), NO_DIRECTION, dtype=np.int32)
            angle = np.zeros(len(unit))
            has = np.flatnonzero((unit != 0).any(axis=1))
            if len(has) and len(pivots):
                angles = _angles(unit[has], pivots)
                cell[has] = angles.argmin(axis=1)
                angle[has] = angles.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "_cell", "_angle"]
            )

    schema = T.StructType([*train.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    return train.mapInArrow(run, schema)


class Cells:
    """What is known about the cells: one entry per pivot, and one for no direction."""

    def __init__(self, pivots: np.ndarray, table: list):
        known = sorted(table, key=lambda r: r["_cell"])
        self.ids = np.array([r["_cell"] for r in known], dtype=np.int32)
        self.sizes = np.array([r["n"] for r in known], dtype=np.int64)
        self.nearest = np.array([r["low"] for r in known])
        self.farthest = np.array([r["high"] for r in known])
        self.pivots = pivots

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The best score each cell could offer each query."""
        directed = self.ids != NO_DIRECTION
        best = np.zeros((len(unit), len(self.ids)))
        if directed.any():
            angle = _angles(unit, self.pivots[self.ids[directed]])
            gap = np.maximum(self.nearest[directed] - angle, angle - self.farthest[directed])
            best[:, directed] = np.cos(np.maximum(gap - SLACK, 0.0))
        best[~(unit != 0).any(axis=1)] = 0.0
        return best

    def home(self, best: np.ndarray, k: int) -> np.ndarray:
        """Most promising cells per query that hold k candidates between them, as a mask."""
        order = np.argsort(-best, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        needed = (held - self.sizes[order]) < k
        mask = np.zeros(best.shape, dtype=bool)
        np.put_along_axis(mask, order, needed, axis=1)
        return mask

    def wanted(self, queries: np.ndarray, k: int, bars: np.ndarray | None) -> np.ndarray:
        """The home cells of each query or, given its bar, all cells that may reach it, as a mask.

        With bars a rounding error does not matter, as ``SLACK`` covers it; home cells may differ
        by one where bounds are equal but for rounding, so nothing but bars is taken from them.
        """
        best = self.bounds(_unit(queries))
        return self.home(best, k) if bars is None else best >= bars[:, None] - SLACK

    def by_part(self, k: int):
        """What :func:`textlab.operators.knn.grid` takes as ``wanted``."""

        def wanted(queries: np.ndarray, bars: np.ndarray | None):
            mask = np.concatenate(
                [self.wanted(queries[i : i + 1024], k, None if bars is None else bars[i : i + 1024])
                 for i in range(0, len(queries), 1024)]
            )
            return lambda cell: np.flatnonzero(mask[:, np.searchsorted(self.ids, cell)])

        return wanted

    def bundles(self, rows: int) -> np.ndarray:
        """For each cell the number of its bundle: a chain of nearest pivots, cut after some ``rows``."""
        directed = np.flatnonzero(self.ids != NO_DIRECTION)
        rest = np.flatnonzero(self.ids == NO_DIRECTION)
        chain: list[int] = []
        if len(directed):
            unit = self.pivots[self.ids[directed]]
            free = np.zeros(len(directed))
            at = 0
            while True:
                chain.append(int(directed[at]))
                free[at] = -np.inf
                if len(chain) == len(directed):
                    break
                at = int((unit @ unit[at] + free).argmax())
        order = np.array([*chain, *rest], dtype=np.int64)
        before = np.cumsum(self.sizes[order]) - self.sizes[order]
        number = np.empty(len(order), dtype=np.int32)
        number[order] = before // rows
        return number


def route(queries: DataFrame, query_id: str, vector: str, cells: Cells, k: int, bar: str | None) -> DataFrame:
    """The ids of the queries of each cell: their home cells or, given their bar, all that may reach it."""
    columns = [query_id, vector] + ([bar] if bar else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bars = part.column(bar).to_numpy(zero_copy_only=False) if bar else None
                rows, cols = np.nonzero(cells.wanted(_matrix(part.column(vector)), k, bars))
                yield pa.RecordBatch.from_arrays(
                    [part.column(query_id).take(pa.array(rows)), pa.array(cells.ids[cols])], names=[query_id, "_cell"]
                )

    schema = T.StructType([queries.schema[query_id], T.StructField("_cell", T.IntegerType())])
    return queries.select(*columns).mapInArrow(run, schema)


def to_bundles(
    queries: DataFrame, query_id: str, vector: str, cells: Cells, bundle: np.ndarray, k: int, bar: str | None
) -> DataFrame:
    """Send each query, with its vector, to the bundles (as ``_cell``) of the cells it wants."""
    by_bundle = np.argsort(bundle, kind="stable")
    numbers, starts = np.unique(bundle[by_bundle], return_index=True)
    columns = [query_id, vector] + ([bar] if bar else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bars = part.column(bar).to_numpy(zero_copy_only=False) if bar else None
                wanted = cells.wanted(_matrix(part.column(vector)), k, bars)
                rows, cols = np.nonzero(np.logical_or.reduceat(wanted[:, by_bundle], starts, axis=1))
                asking = part.select(columns)
                for lo in range(0, len(rows), SENT_ROWS):
                    sent = asking.take(pa.array(rows[lo : lo + SENT_ROWS]))
                    yield pa.RecordBatch.from_arrays(
                        [*sent.columns, pa.array(numbers[cols[lo : lo + SENT_ROWS]])], names=[*columns, "_cell"]
                    )

    schema = T.StructType([*(queries.schema[c] for c in columns), T.StructField("_cell", T.IntegerType())])
    return queries.select(*columns).mapInArrow(run, schema)


def bundled_grid(sent, train, part, cells, bundle, wanted, asked, dims, block_bytes, k, enough, bar, **names) -> DataFrame:
    """Queries sent to bundles meet the candidates of those; ``part`` is the candidates' cell.

    ``wanted`` are the cells that any query goes to, ``asked`` is the number of queries of each bundle.
    """
    spark = sent.sparkSession
    read = np.isin(cells.ids, list(wanted))
    held = {b: int(cells.sizes[read & (bundle == b)].sum()) for b in asked}
    q_rows = grid_rows(max(asked.values(), default=1), dims, block_bytes)
    t_rows = grid_rows(int(cells.sizes.sum()), dims, block_bytes)
    blocks = {b: (-(-n // q_rows), max(1, -(-held[b] // t_rows))) for b, n in asked.items()}
    numbered = zip(cells.ids.tolist(), bundle.tolist())
    listed = [(c, b, *blocks[b]) for c, b in numbered if c in wanted and b in blocks]
    of_cells = spark.createDataFrame(listed, "_part INT, _cell INT, q_blocks INT, t_blocks INT")
    sizes = spark.createDataFrame([(b, *x) for b, x in blocks.items()], "_cell INT, q_blocks INT, t_blocks INT")
    return grid(
        sent.join(F.broadcast(sizes), "_cell"),
        train.withColumnRenamed(part, "_part").join(F.broadcast(of_cells), "_part"),
        k,
        max(1, sum(q * t for q, t in blocks.values())),
        (q_rows + t_rows) * dims * 8,
        part="_part",
        bar=bar,
        wanted=cells.by_part(enough),
        **names,
    )


def asked_of(sent: DataFrame) -> dict[int, int]:
    """How many queries each cell or bundle gets."""
    return {r["_cell"]: r["n"] for r in sent.groupBy("_cell").agg(F.count("*").alias("n")).collect()}


def barred(queries: DataFrame, query_id: str, vector: str, first: DataFrame, k: int) -> DataFrame:
    """The queries with the k-th score of a first search as ``_bar``; stored."""
    bars = first.groupBy(F.col("qid").alias(query_id)).agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("_bar")
    )
    found = queries.select(query_id, vector).join(bars, query_id, "left")
    return materialize(found.fillna(float("-inf"), ["_bar"]), "barred")


def knn_pruned(queries, train, k, query_id, train_id, vector, exclude_self, carry, block_bytes, shape):
    """See the module.  Stores the located candidates and the queries with their bars."""
    n_train, dims = shape
    pivots = choose_pivots(train, train_id, vector, n_train)
    located = materialize(locate(train.select(train_id, *carry, vector), vector, pivots), "located")
    # One row per cell, at most MAX_PIVOTS + 1.
    table = (
        located.groupBy("_cell")
        .agg(F.count("*").alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high"))
        .collect()
    )
    cells = Cells(pivots, table)
    bundle = cells.bundles(grid_rows(n_train, dims, block_bytes))
    enough = k + 1 if exclude_self else k
    names = {"query_id": query_id, "train_id": train_id, "vector": vector, "exclude_self": exclude_self}

    def one_pass(asking: DataFrame, bar: str | None, carried: list) -> DataFrame:
        if not len(bundle):
            schema = _result_schema(queries, located, query_id, train_id, carried)
            return merge_top_k(queries.sparkSession.createDataFrame([], schema), k)
        wanted = asked_of(route(asking, query_id, vector, cells, enough, bar))
        sent = to_bundles(asking, query_id, vector, cells, bundle, enough, bar)
        parts = bundled_grid(
            sent, located, "_cell", cells, bundle, wanted, asked_of(sent), dims, block_bytes, k, enough, bar, carry=carried, **names
        )
        return merge_top_k(parts, k)

    first = one_pass(queries, None, [])
    return one_pass(barred(queries, query_id, vector, first, k), "_bar", list(carry))
