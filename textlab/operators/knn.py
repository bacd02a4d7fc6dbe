"""Exact cosine top-k join.

Exact search compares a query with every candidate it cannot rule out, so the work is
quadratic in the worst case; what matters is that pairs are scored in dense blocks, that no
pair leaves the task that scored it unless it is in that task's top k, and that no task
holds more than two bounded blocks.

* ``broadcast``: the candidate side is counted first and, below a byte limit, shipped to
  every executor.  Queries are scored where they lie; nothing is shuffled.
* ``block``: both sides are stored once as blocks.  A task holds a block of queries, reads one
  block of candidates after the other, and emits its top k; a window merges the tasks.  So
  disk is in proportion to the tables, and only what is read grows with their product.

* ``pruned``: candidates are grouped around pivots, and a query meets only the groups that
  can still hold a better neighbour than those it has (see ``knn_pruned``).  Pays off where
  vectors form clusters; on vectors without structure it does the work of ``block`` and more.

All score a pair with the same arithmetic, so they return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from textlab.storage import file_system, qualified, scratch_path

# A candidate matrix up to this size (as doubles) is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Most that one block (as doubles) on either side of a grid cell grows to, and where it begins.
BLOCK_BYTES = 64 * 1024 * 1024
FIRST_BLOCK_BYTES = 16 * 1024 * 1024
# Most tasks a grid is dealt out to, and the blocks that are worth a task.
MAX_TASKS = 20_000
TASK_BYTES = 32 * 1024 * 1024
# Copies of a row that a grid lays out before blocks smaller than BLOCK_BYTES grow with the table.
COPIES = 16
# Scores held at once while a block pair is worked off, and candidates they are for.
SCORE_BYTES = 4 * 1024 * 1024
TILE = 2048
# Candidates whose scores give the first bar.
FIRST_SCORES = 512
# Hits held at once while the cells of a block pair are worked off.
HELD_HITS = 2_000_000
# Vectors rescored at once in double precision.
RESCORE_BYTES = 32 * 1024 * 1024
# Rows of a result handed over at once.
SENT_ROWS = 65_536


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a 2-d array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths).as_py() != pc.max(lengths).as_py():
        raise ValueError("vectors of one table must be there and have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(rows, -1).astype(np.float64, copy=False)
    if not np.isfinite(matrix).all():
        raise ValueError("vectors must hold finite numbers")
    return matrix


def _unit(matrix: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Rows, or those of ``order``, scaled to length one; zero rows stay zero."""
    n = len(matrix) if order is None else len(order)
    out = np.zeros((n, matrix.shape[1]))
    piece = max(1, RESCORE_BYTES // (8 * max(matrix.shape[1], 1)))
    for lo in range(0, n, piece):
        part = matrix[lo : lo + piece] if order is None else matrix[order[lo : lo + piece]]
        norms = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, norms, out=out[lo : lo + piece], where=norms > 0)
    return out


def _copy_numbers(unit: np.ndarray) -> np.ndarray:
    """For each row how many rows before it are the same.

    Rows meet by a hash.  A row that differs from the first one of its hash counts as without copies.
    """
    n, dims = unit.shape
    factors = np.random.default_rng(0).integers(0, 2**63, dims, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = np.empty(n, dtype=np.uint64)
    piece = max(1, RESCORE_BYTES // (8 * max(dims, 1)))
    for lo in range(0, n, piece):
        bits = unit[lo : lo + piece].view(np.uint64)
        hashes[lo : lo + piece] = ((bits ^ (bits >> np.uint64(29))) * factors).sum(axis=1)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(starts, n))
    first = np.empty(n, dtype=np.int64)
    first[order] = np.repeat(order[starts], sizes)
    same = np.ones(n, dtype=bool)
    for lo in range(0, n, piece):
        at = np.flatnonzero(first[lo : lo + piece] != np.arange(lo, min(lo + piece, n))) + lo
        same[at] = (unit[at].view(np.uint64) == unit[first[at]].view(np.uint64)).all(axis=1)
    alike = order[same[order]]
    groups = first[alike]
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(starts, len(alike)))
    numbers = np.zeros(n, dtype=np.int64)
    numbers[alike] = np.arange(len(alike)) - np.repeat(starts, sizes)
    return numbers


class Candidates:
    """A block of candidate vectors, ready to be searched.

    Rows are ordered by id so that among equal scores the smaller id comes first.  Of a
    group of identical vectors only as many copies are searched as can be in a result:
    copies score alike, so the later ones always lose to the first ``k`` (``k + 1`` where
    a query may be one of them).
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, unit = ids[order], _unit(matrix, order)
        if len(ids) > k + 1:
            copies = _copy_numbers(unit)
            if copies.max() > k:
                keep = np.flatnonzero(copies <= k)
                order, ids, unit = order[keep], ids[keep], unit[keep]
        self.rows = order  # positions in the caller's table
        self.ids = ids
        self.unit = unit
        self.single = unit.astype(np.float32)

    @classmethod
    def restore(cls, arrays: dict[str, np.ndarray]) -> Candidates:
        """A block from its ``vars()``, the form in which it is broadcast."""
        block = cls.__new__(cls)
        vars(block).update(arrays)
        return block

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool, floor: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Top k per query, as (query position, candidate position, score) in rank order.

        Single precision finds everything that could be in the top k, with the worst
        rounding error of such a product as safety margin; double precision then decides.
        Candidates are scored a tile at a time; of each tile only what reaches the k-th
        score so far is looked at.  Scores below a query's ``floor`` may be left out.
        """
        n, dims = self.unit.shape
        if n == 0 or len(query_ids) == 0:
            return
        if queries.shape[1] != dims:
            raise ValueError("queries and candidates must have the same vector length")
        margin = np.float32(2.0 * (dims + 4) * 2.0**-23)
        step = max(1, SCORE_BYTES // (4 * min(n, TILE)))
        for start in range(0, len(query_ids), step):
            ids = query_ids[start : start + step]
            unit = _unit(queries[start : start + step])
            single = unit.astype(np.float32)
            limit = np.full(len(ids), -2.0, dtype=np.float32)
            if floor is not None:
                np.maximum(limit, floor[start : start + step].astype(np.float32) - margin, out=limit)
            own = at = np.zeros(0, dtype=np.int64)
            if exclude_self:
                at = np.minimum(np.searchsorted(self.ids, ids), n - 1)
                own = np.flatnonzero(self.ids[at] == ids)
                at = at[own]
            rows = cols = np.zeros(0, dtype=np.int64)
            values = np.zeros(0)
            for lo in range(0, n, TILE):
                scores = single @ self.single[lo : lo + TILE].T
                here = (at >= lo) & (at < lo + TILE)
                scores[own[here], at[here] - lo] = -np.inf
                if lo == 0 and floor is None and scores.shape[1] > k:
                    few = max(FIRST_SCORES, 2 * k)
                    sample = scores[:, :few]
                    kth = np.partition(sample, sample.shape[1] - k, axis=1)[:, sample.shape[1] - k]
                    np.maximum(limit, kth - margin, out=limit)
                flat = np.flatnonzero(scores >= limit[:, None])
                if not len(flat):
                    continue
                r, c = np.divmod(flat, scores.shape[1])
                rows, cols = np.concatenate([rows, r]), np.concatenate([cols, c + lo])
                values = np.concatenate([values, scores.ravel()[flat]])
                if len(rows) > HELD_HITS:
                    rows, cols, values = self._best(unit, rows, cols, k)
                order = np.lexsort((-values, rows))
                rows, cols, values = rows[order], cols[order], values[order]
                first = np.searchsorted(rows, np.arange(len(ids)))
                full = np.flatnonzero(np.diff(np.append(first, len(rows))) >= k)
                kth = values[first[full] + k - 1].astype(np.float32) - margin
                limit[full] = np.maximum(limit[full], kth)
                stay = values >= limit[rows]
                rows, cols, values = rows[stay], cols[stay], values[stay]
            rows, cols, exact = self._best(unit, rows, cols, k)
            yield start + rows, cols, exact

    def _best(
        self, unit: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The top k per query of pairs of queries and candidates, by their scores in double precision."""
        piece = max(1, RESCORE_BYTES // (8 * unit.shape[1]))
        exact = np.empty(len(rows))
        for lo in range(0, len(rows), piece):
            part = slice(lo, lo + piece)
            exact[part] = (unit[rows[part]] * self.unit[cols[part]]).sum(axis=1)
        order = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[best], cols[best], exact[best]


def vector_shape(df: DataFrame, vector: str) -> tuple[int, int]:
    """Row count and vector length of a table."""
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    return int(row["n"]), int(row["d"] or 0)


def carried_bytes(df: DataFrame, columns: Sequence[str]) -> int:
    """Size of the values of some columns, as text."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns]
    return int(df.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("bigint")), F.lit(0))).first()[0])


def _result_schema(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, carry: Sequence[str]):
    fields = [
        T.StructField("qid", queries.schema[query_id].dataType),
        T.StructField("tid", train.schema[train_id].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    return T.StructType(fields + [train.schema[c] for c in carry])


def _emit(
    query_ids: pa.Array, table: pa.Table, found: Candidates, matrix: np.ndarray, k: int, exclude_self: bool,
    names: Sequence[str],
) -> Iterator[tuple[pa.Array, list[pa.Array], np.ndarray]]:
    keys = query_ids.to_numpy(zero_copy_only=False)
    for q, c, score in found.search(keys, matrix, k, exclude_self):
        picked = table.select(list(names)).take(pa.array(found.rows[c]))
        yield pa.array(keys[q]), [col.combine_chunks() for col in picked.columns], score


def broadcast_matcher(
    train: DataFrame, k: int, *, query_id: str, train_id: str, vector: str, exclude_self: bool, carry: Sequence[str]
):
    """A ``mapInArrow`` function that searches a candidate table small enough to ship.

    The caller has checked the size of ``train``.
    """
    names = [train_id, *carry]
    table = train.select(*names, vector).toArrow()
    index = Candidates(
        table.column(train_id).to_numpy(), _matrix(table.column(vector)), k
    )
    shipped = train.sparkSession.sparkContext.broadcast((table.select(names), vars(index)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload, arrays = shipped.value
        found = Candidates.restore(arrays)
        for batch in batches:
            hits = _emit(
                batch.column(query_id), payload, found, _matrix(batch.column(vector)), k, exclude_self, names
            )
            for qid, (tid, *carried), score in hits:
                # Results come in rank order, so a rank is the distance to the query's first row.
                codes = qid.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
                rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) + 1
                yield pa.RecordBatch.from_arrays(
                    [qid, tid, pa.array(score), *carried, pa.array(rank.astype(np.int32))],
                    names=["qid", "tid", "score", *carry, "rank"],
                )

    return match


def _knn_broadcast(queries, train, k, query_id, train_id, vector, exclude_self, carry):
    match = broadcast_matcher(
        train, k, query_id=query_id, train_id=train_id, vector=vector, exclude_self=exclude_self, carry=carry
    )
    schema = _result_schema(queries, train, query_id, train_id, carry).add("rank", T.IntegerType())
    return queries.select(query_id, vector).mapInArrow(match, schema)


def block_rows(block_bytes: int, dims: int) -> int:
    """Vectors in a block of the given size."""
    return max(1, block_bytes // (8 * max(dims, 1)))


def grid_rows(n: int, dims: int, block_bytes: int) -> int:
    """Vectors in a block of a side of ``n`` rows.

    A row meets every block of the other side, so blocks of a fixed small size would have a
    table copied as many times as the other one has rows.  Blocks grow with their table, up
    to ``BLOCK_BYTES``, to keep that to ``COPIES`` times.
    """
    grown = min(-(-n // COPIES), block_rows(BLOCK_BYTES, dims))
    return max(block_rows(block_bytes, dims), grown)


def search_cells(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    matrix: np.ndarray,
    cell: np.ndarray,
    wanted: Callable[[int], np.ndarray],
    k: int,
    exclude_self: bool,
    bars: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k per query over the cells it wants, as (query position, candidate position, score).

    Scores below a query's bar may be left out.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def best() -> tuple[np.ndarray, ...]:
        if not held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        q, c, score = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], c[first], score[first]

    for number in np.unique(cell):
        asking = wanted(int(number))
        if not len(asking):
            continue
        at = np.flatnonzero(cell == number)
        found = Candidates(ids[at], matrix[at], k)
        floor = None if bars is None else bars[asking]
        for q, c, score in found.search(query_ids[asking], queries[asking], k, exclude_self, floor):
            held.append((asking[q], at[found.rows[c]], score))
            if sum(len(h[0]) for h in held) > HELD_HITS:
                held[:] = [best()]
    return best()


def grid(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    pairs: int,
    pair_bytes: int,
    *,
    query_id: str,
    train_id: str,
    vector: str,
    exclude_self: bool,
    carry: Sequence[str],
    part: str | None = None,
    bar: str | None = None,
    wanted: Callable[[np.ndarray, np.ndarray | None], Callable[[int], np.ndarray]] | None = None,
) -> DataFrame:
    """Score queries against the candidates of the same ``_cell``, block pair by block pair.

    Either side also has ``q_blocks`` and ``t_blocks``, the cell's number of blocks; ``pairs``
    is the number of block pairs in all, of at most ``pair_bytes`` each.  Gives the top k of each block pair as ``qid, tid,
    score, *carry``.

    A cell may be made of parts, by the column ``part`` of ``train``.  ``wanted`` then gives for
    query vectors, and their values of ``bar``, which of them each part has to be searched for.
    """
    # The work is in the pairs and not in the bytes, so their number decides how many tasks
    # there are; twice as many leaves few tasks with several pairs.  Pairs of small blocks
    # share tasks, a few for each core.
    worth = max(4 * queries.sparkSession.sparkContext.defaultParallelism, 2 * pairs * pair_bytes // TASK_BYTES)
    tasks = min(2 * pairs, worth, MAX_TASKS)

    def laid_out(df, key, extra, own, own_blocks, other, other_blocks):
        # Ids are unique, so a hash of the id gives even blocks whatever the data looks like.
        # New column names keep the sides apart where both come from one table.
        columns = [F.col(key).alias("_id"), F.col(vector).alias("_v"), *[F.col(c).alias(c) for c in extra]]
        return df.select(
            F.col("_cell").alias("_cell"),
            F.pmod(F.xxhash64(key), F.col(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(other),
            *columns,
        ).repartition(tasks, *keys)

    keys = ("_cell", "_qb", "_tb")

    q = laid_out(queries, query_id, [bar] if bar else [], "_qb", "q_blocks", "_tb", "t_blocks")
    t = laid_out(train, train_id, [*carry, part] if part else carry, "_tb", "t_blocks", "_qb", "q_blocks")
    schema = _result_schema(queries, train, query_id, train_id, carry)
    arrow_names = schema.names

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows and part:
            ids, queries = left.column("_id").to_numpy(), _matrix(left.column("_v"))
            bars = left.column(bar).to_numpy() if bar else None
            q, c, scores = search_cells(
                ids, queries, right.column("_id").to_numpy(), _matrix(right.column("_v")),
                right.column(part).to_numpy(), wanted(queries, bars), k, exclude_self, bars,
            )
            picked = right.select(["_id", *carry]).take(pa.array(c))
            parts.append(pa.table([pa.array(ids[q]), picked.column(0), pa.array(scores), *picked.columns[1:]], names=arrow_names))
        elif left.num_rows and right.num_rows:
            found = Candidates(right.column("_id").to_numpy(), _matrix(right.column("_v")), k)
            ids = left.column("_id").combine_chunks()
            hits = _emit(ids, right, found, _matrix(left.column("_v")), k, exclude_self, ["_id", *carry])
            for qid, (tid, *carried), scores in hits:
                parts.append(pa.table([qid, tid, pa.array(scores), *carried], names=arrow_names))
        if parts:
            return pa.concat_tables(parts)
        kinds = [left.schema.field("_id").type, right.schema.field("_id").type, pa.float64()]
        kinds += [right.schema.field(c).type for c in carry]
        return pa.table([pa.array([], type=kind) for kind in kinds], names=arrow_names)

    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(score, schema)


def merge_top_k(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all block pairs, with their ``rank``."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "tid")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _blocks(spark: SparkSession, folder: str, rows: int) -> list[list[str]]:
    """The files of a folder in groups of at most so many rows, or of one file."""
    counts = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).count().collect()
    blocks: list[list[str]] = []
    room = 0
    for row in sorted(counts):
        if row["count"] > room or not blocks:
            blocks.append([])
            room = rows
        blocks[-1].append(row["file"])
        room -= row["count"]
    return blocks


def _best_of(
    parts: Sequence[tuple[np.ndarray, pa.Table, np.ndarray]], k: int
) -> tuple[np.ndarray, pa.Table, np.ndarray]:
    """The top k per query of hits: query position, candidate columns with the id first, score."""
    q, score = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    picked = pa.concat_tables([p[1] for p in parts])
    order = np.lexsort((picked.column(0).to_numpy(), -score, q))
    order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
    return q[order], picked.take(pa.array(order)), score[order]


def stored_search(
    queries: DataFrame, train: DataFrame, k: int, q_rows: int, t_rows: int, t_blocks: int, *, query_id: str,
    train_id: str, vector: str, exclude_self: bool, carry: Sequence[str],
) -> DataFrame:
    """Score stored blocks of queries against stored blocks of candidates: ``qid, tid, score, *carry``.

    Both sides are written here, each row once.  A task takes a block of queries and a share of the
    candidates' blocks, which it reads one at a time, and gives the top k of that share; a query's
    k-th score so far is the bar for the next block.  There are as many shares as the cores ask for.
    """
    spark = queries.sparkSession
    schema = _result_schema(queries, train, query_id, train_id, carry)
    asked_at, held_at = scratch_path(spark, "queries"), scratch_path(spark, "candidates")
    asked = queries.select(F.col(query_id).alias("_id"), F.col(vector).alias("_v"))
    asked.write.option("maxRecordsPerFile", q_rows).parquet(asked_at)
    # By hash of the id, so that rows that share one are in one block whatever the data looks like.
    # New column names keep carried columns apart.
    names = [f"_c{i}" for i in range(len(carry))]
    columns = [F.col(c).alias(name) for c, name in zip(carry, names)]
    laid_out = train.select(F.col(train_id).alias("_id"), F.col(vector).alias("_v"), *columns)
    laid_out.repartition(t_blocks, "_id").write.parquet(held_at)
    asking, searched = _blocks(spark, asked_at, q_rows), _blocks(spark, held_at, t_rows)
    if not asking or not searched:
        return spark.createDataFrame([], schema)
    shares = min(len(searched), -(-4 * spark.sparkContext.defaultParallelism // len(asking)))
    folders = qualified(spark, asked_at), qualified(spark, held_at)
    kinds = [to_arrow_type(train.schema[c].dataType) for c in carry]

    def read(folder: str, files: Sequence[str], columns: Sequence[str]) -> pa.Table:
        from pyarrow import parquet

        system, root = file_system(folder)
        tables = [parquet.ParquetFile(f"{root}/{f}", filesystem=system).read(list(columns)) for f in files]
        return pa.concat_tables(tables)

    def hits(number: int) -> Iterator[pa.RecordBatch]:
        block, share = divmod(number, shares)
        left = read(folders[0], asking[block], ["_id", "_v"])
        ids, matrix = left.column("_id").to_numpy(), _matrix(left.column("_v"))
        del left
        best, bars = None, None
        for files in searched[share::shares]:
            right = read(folders[1], files, ["_id", "_v", *names])
            found = Candidates(right.column("_id").to_numpy(), _matrix(right.column("_v")), k)
            right = right.select(["_id", *names])
            parts = [] if best is None else [best]
            for q, c, score in found.search(ids, matrix, k, exclude_self, bars):
                parts.append((q, right.take(pa.array(found.rows[c])), score))
            if not parts:
                continue
            best = _best_of(parts, k)
            first = np.searchsorted(best[0], np.arange(len(ids) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            bars = np.full(len(ids), -2.0)
            bars[full] = best[2][first[full] + k - 1]
        if best is not None:
            q, picked, score = best
            carried = [picked.column(name).cast(kind) for name, kind in zip(names, kinds)]
            rows = pa.table([pa.array(ids[q]), picked.column("_id"), pa.array(score), *carried], names=schema.names)
            yield from rows.combine_chunks().to_batches(SENT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield from hits(number)

    tasks = len(asking) * shares
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _reachable(spark: SparkSession) -> bool:
    """Whether Python workers can read what Spark stores."""
    try:
        file_system(qualified(spark, scratch_path(spark, "blocks")))
    except (ValueError, pa.ArrowException, OSError):
        return False
    return True


def _knn_block(queries, train, k, query_id, train_id, vector, exclude_self, carry, block_bytes, shape):
    n_train, dims = shape
    n_query, _ = vector_shape(queries, vector)
    q_rows, t_rows = (grid_rows(n, dims, block_bytes) for n in (n_query, n_train))
    q_blocks, t_blocks = max(1, -(-n_query // q_rows)), max(1, -(-n_train // t_rows))
    if q_blocks * t_blocks > 1 and _reachable(queries.sparkSession):
        names = {"query_id": query_id, "train_id": train_id, "vector": vector, "exclude_self": exclude_self, "carry": carry}
        return merge_top_k(stored_search(queries, train, k, q_rows, t_rows, t_blocks, **names), k)
    # One block pair is shuffled once.  Where workers cannot read, blocks come to them as a grid of copies.
    one_cell = {"_cell": F.lit(0), "q_blocks": F.lit(q_blocks), "t_blocks": F.lit(t_blocks)}
    parts = grid(
        queries.withColumns(one_cell),
        train.withColumns(one_cell),
        k,
        q_blocks * t_blocks,
        (q_rows + t_rows) * dims * 8,
        query_id=query_id,
        train_id=train_id,
        vector=vector,
        exclude_self=exclude_self,
        carry=carry,
    )
    return merge_top_k(parts, k)


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    *,
    query_id: str = "id",
    train_id: str = "id",
    vector: str = "embedding",
    exclude_self: bool = False,
    carry: Sequence[str] = (),
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = FIRST_BLOCK_BYTES,
) -> DataFrame:
    """The k nearest candidates of every query: ``qid, tid, score, *carry, rank``.

    Cosine similarity, highest first, equal scores by smaller id; fewer than k candidates
    give fewer rows.  ``exclude_self`` drops the candidate with the query's own id (copies
    of its vector under other ids stay).  Only rows of ``train`` can be neighbours, so
    passing the training split there is what keeps held-out rows out of every result.
    ``carry`` takes small candidate columns (a label, a model name) along and saves a join.

    A candidate table is only shipped to the tasks if vectors and carried columns together
    are within ``broadcast_bytes``; beyond that ``"broadcast"`` too takes the block form, which
    gives the same rows.  Blocks of fewer than ``BLOCK_BYTES`` grow with the tables (see
    :func:`grid_rows`).  ``"auto"`` never takes ``"pruned"``, which pays on clustered vectors.

    Measuring ``train`` (and in the block form ``queries``, and storing the blocks) is a job of its own; give
    stored tables.  Ids are whole numbers, unique on either side.
    """
    if strategy not in ("auto", "broadcast", "block", "pruned"):
        raise ValueError(f"unknown strategy: {strategy}")
    shape = vector_shape(train, vector)
    fits = shape[0] * shape[1] * 8 <= broadcast_bytes
    if fits and carry and strategy in ("auto", "broadcast"):
        fits = shape[0] * shape[1] * 8 + carried_bytes(train, carry) <= broadcast_bytes
    columns = (queries, train, k, query_id, train_id, vector, exclude_self, list(carry))
    if strategy == "pruned":
        from textlab.operators.knn_pruned import knn_pruned

        result = knn_pruned(*columns, block_bytes, shape)
    elif fits and strategy != "block":
        result = _knn_broadcast(*columns)
    else:
        result = _knn_block(*columns, block_bytes, shape)
    return result.select("qid", "tid", "score", *carry, "rank")


def neighbour_payload(neighbours: DataFrame, corpus: DataFrame, columns: dict, key: str = "id") -> DataFrame:
    """Look up neighbour columns: ``columns`` maps result names to corpus expressions.

    A row that is everybody's neighbour makes its id hot; the adaptive skew join splits
    that side, the corpus side has unique ids.
    """
    payload = corpus.select(F.col(key).alias("tid"), *[c.alias(name) for name, c in columns.items()])
    return neighbours.join(payload, "tid")
