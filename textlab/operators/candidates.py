"""Candidate vectors stored once, searched many times, and added to.

A store is a folder:

* ``pivots``  the directions that candidates are grouped around; they never change
* ``rows``    candidates with their angle to the nearest pivot, in ``batch=.../cell=...``
* ``cells``   for each batch and cell how many candidates there are and their range of angles

A search reads the cell table, a row per cell, and of the candidates only the cells that can
hold a neighbour (see ``knn_pruned`` for the bounds).  Queries are shipped to the candidates
if what is asked of the cells is small: then no candidate is shuffled, and nothing of the store
is measured or laid out again.  Otherwise both meet in a grid of blocks.

A batch counts once its lines are in the cell table, which is written last, so a batch
that fails half-way is never seen, and one that is added again under its name is not added twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textlab.operators.knn import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    _matrix,
    _result_schema,
    broadcast_matcher,
    carried_bytes,
    grid_rows,
    merge_top_k,
    search_cells,
    vector_shape,
)
from textlab.operators.knn_pruned import Cells, asked_of, barred, bundled_grid, choose_pivots, locate, route, to_bundles
from textlab.storage import materialize, scratch_path

_CELLS = "batch STRING, cell INT, n BIGINT, low DOUBLE, high DOUBLE, dims INT"


class CandidateStore:
    """A folder of candidates with ``id``, a vector and some carried columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        stored = spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").toArrow()
        self.pivots = _matrix(stored.column("direction"))
        self.schema = spark.read.parquet(f"{self.path}/columns").schema["row"].dataType
        self.id_col, *self.carry, self.vector = self.schema.names

    @classmethod
    def create(
        cls, train: DataFrame, path: str, *, id_col: str = "id", vector: str = "embedding", carry: Sequence[str] = ()
    ) -> CandidateStore:
        """A new store of the rows of ``train``, at least one of which has a direction.

        Ids are whole numbers, unique in the store.
        """
        spark, path = train.sparkSession, path.rstrip("/")
        rows = train.select(id_col, *carry, vector)
        n, _ = vector_shape(rows, vector)
        pivots = choose_pivots(rows, id_col, vector, n) if n else np.empty((0, 0))
        if not len(pivots):
            raise ValueError("a store of candidates begins with at least one vector that is not zero")
        listed = [(i, [float(x) for x in p]) for i, p in enumerate(pivots)]
        spark.createDataFrame(listed, "pivot INT, direction ARRAY<DOUBLE>").coalesce(1).write.parquet(f"{path}/pivots")
        # An empty table that keeps the columns' names and types.
        spark.createDataFrame([], T.StructType([T.StructField("row", rows.schema)])).write.parquet(f"{path}/columns")
        store = cls(spark, path)
        store.append(rows, "0")
        return store

    def _cell_rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _CELLS)

    def batches(self) -> list[str]:
        """Names of the batches that count."""
        return sorted(r[0] for r in self._cell_rows().select("batch").distinct().collect())

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add candidates.  A batch that is there already, by its name, is left as it is."""
        batch = batch or uuid.uuid4().hex
        if not self._cell_rows().filter(F.col("batch") == batch).isEmpty():
            return
        rows = rows.select(*self.schema.names)
        folder = f"{self.path}/rows/batch={batch}"
        located = locate(rows, self.vector, self.pivots)
        located = located.withColumnRenamed("_cell", "cell").withColumnRenamed("_angle", "angle")
        # Few files for small cells, several for one that holds most of the rows.
        located.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(folder)
        schema = T.StructType([*self.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        written = self.spark.read.schema(schema).parquet(folder)
        table = written.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"),
            F.max(F.size(self.vector)).alias("dims"),
        )
        table = table.select(F.lit(batch).alias("batch"), "cell", "n", "low", "high", "dims")
        table.coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The candidates of some cells (or all): ``id, *carry, vector, cell``.  Other cells' files are not read."""
        wanted = [f"{self.path}/rows/batch={b}" for b in self.batches()]
        schema = T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType())])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*wanted)
        return found if cells is None else found.filter(F.col("cell").isin([int(c) for c in cells]))

    def search(
        self,
        queries: DataFrame,
        k: int,
        *,
        query_id: str = "id",
        vector: str = "embedding",
        exclude_self: bool = False,
        ship_bytes: int = BROADCAST_BYTES,
        block_bytes: int = BLOCK_BYTES,
    ) -> DataFrame:
        """The ``k`` nearest candidates of every query: ``qid, tid, score, *carry, rank``; stored.

        The same rows as :func:`textlab.operators.knn.knn_join` against all candidates.  Queries
        are read more than once; give a stored table.
        """
        table = (
            self._cell_rows()
            .groupBy(F.col("cell").alias("_cell"))
            .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("dims").alias("dims"))
            .collect()
        )
        cells = Cells(self.pivots, table)
        dims = max((r["dims"] for r in table), default=0)
        bundle = cells.bundles(grid_rows(int(cells.sizes.sum()), dims, block_bytes))
        enough = k + 1 if exclude_self else k

        def one_pass(asking: DataFrame, bar: str | None, carried: list[str]) -> DataFrame:
            if not len(bundle):
                return self.spark.createDataFrame([], _result_schema(asking, self.rows([]), query_id, self.id_col, carried))
            wanted = asked_of(route(asking, query_id, vector, cells, enough, bar))
            sent = to_bundles(asking, query_id, vector, cells, bundle, enough, bar)
            asked = asked_of(sent)
            if sum(asked.values()) * dims * 8 <= ship_bytes:
                parts = dict(zip(cells.ids.tolist(), bundle.tolist()))
                masks = cells.by_part(enough)
                return self._shipped(sent, list(wanted), k, query_id, vector, exclude_self, carried, bar, parts, masks)
            candidates = self.rows(list(wanted)).withColumnRenamed(self.vector, vector)
            names = {"query_id": query_id, "train_id": self.id_col, "vector": vector, "carry": carried}
            return bundled_grid(
                sent, candidates, "cell", cells, bundle, wanted, asked, dims, block_bytes, k, enough, bar, exclude_self=exclude_self, **names
            )

        first = merge_top_k(one_pass(queries, None, []), k)
        asking = barred(queries, query_id, vector, first, k)
        merged = merge_top_k(one_pass(asking, "_bar", self.carry), k)
        return materialize(merged.select("qid", "tid", "score", *self.carry, "rank"), "neighbours")

    def _shipped(
        self, sent: DataFrame, wanted: Sequence[int], k: int, query_id: str, vector: str, exclude_self: bool,
        carry: Sequence[str] = (), bar: str | None = None, numbers: dict[int, int] | None = None,
        by_part: Callable[[np.ndarray, np.ndarray | None], Callable[[int], np.ndarray]] | None = None,
    ) -> DataFrame:
        """Score the candidates of the ``wanted`` cells where they lie; the caller has checked the size of ``sent``.

        ``numbers`` has the bundle of each cell and ``by_part`` tells which queries of a bundle go to a
        cell.  Without them queries are sent to cells.
        """
        table = sent.toArrow()
        place = table.column("_cell").to_numpy()
        ids, matrix = table.column(query_id).to_numpy(), _matrix(table.column(vector))
        bars = table.column(bar).to_numpy() if bar else None
        asked = {}
        for b in np.unique(place):
            at = np.flatnonzero(place == b)
            asked[int(b)] = ids[at], matrix[at], None if bars is None else bars[at]
        shipped = self.spark.sparkContext.broadcast(asked)
        numbers = numbers or {int(c): int(c) for c in wanted}
        by_part = by_part or (lambda queries, bars: lambda cell: np.arange(len(queries)))
        train_id, own = self.id_col, self.vector
        names = [train_id, *carry]
        schema = _result_schema(sent, self.rows([]), query_id, train_id, carry)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            masks = {}
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                of_batch = np.array([numbers[c] for c in cell.tolist()], dtype=np.int32)
                for b in np.unique(of_batch):
                    if b not in shipped.value:
                        continue
                    query_ids, asking, limits = shipped.value[int(b)]
                    if b not in masks:
                        masks[b] = by_part(asking, limits)
                    at = np.flatnonzero(of_batch == b)
                    rows = pa.Table.from_batches([batch]).take(pa.array(at))
                    q, c, score = search_cells(
                        query_ids, asking, rows.column(train_id).to_numpy(), _matrix(rows.column(own)), cell[at],
                        masks[b], k, exclude_self, limits,
                    )
                    picked = rows.select(names).take(pa.array(c))
                    tid, *carried = (col.combine_chunks() for col in picked.columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[q]), tid, pa.array(score), *carried], names=["qid", "tid", "score", *carry]
                    )

        return self.rows(wanted).mapInArrow(match, schema)


def prepared(
    train: DataFrame | CandidateStore,
    k: int,
    *,
    vector: str = "embedding",
    carry: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Callable[[DataFrame], DataFrame]:
    """A search that is set up once for many query tables with ``id`` and ``vector``.

    A small table is measured and shipped here, a large one is stored by cell here; a store is
    taken as it is, with what is added to it later.  The result gives ``qid, tid, score, *carry,
    rank`` of a query table.
    """
    if isinstance(train, DataFrame):
        n, dims = vector_shape(train, vector)
        size = n * dims * 8
        if size <= broadcast_bytes and size + (carried_bytes(train, carry) if carry else 0) <= broadcast_bytes:
            match = broadcast_matcher(
                train, k, query_id="id", train_id="id", vector=vector, exclude_self=False, carry=list(carry)
            )
            kinds = {c: train.schema[c] for c in ("id", *carry)}

            def shipped(queries: DataFrame) -> DataFrame:
                schema = _result_schema(queries, train.select(*kinds), "id", "id", list(carry))
                return queries.select("id", vector).mapInArrow(match, schema.add("rank", T.IntegerType()))

            return shipped
        path = scratch_path(train.sparkSession, "candidates")
        train = CandidateStore.create(train, path, vector=vector, carry=carry)
    store = train
    return lambda queries: store.search(queries, k, vector=vector, ship_bytes=broadcast_bytes)
