"""Plain CSV files with quoted line breaks, read in pieces.

Whether a line break ends a record depends on the quotes before it, back to the start of the
file: it does after an even number of them.  So one pass counts the quotes of each block of a
file, a running sum over the blocks tells each whether it begins inside a record, and a
second pass cuts every block into records on its own.  Only a record that lies across
blocks is put together from pieces; all others stay in the task that has read them.

Quotes are those of the usual format: around fields, doubled within them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textlab.storage import materialize

_LINES = ("_file", "_block", "value")


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines in the order of each block; a line belongs to the block in which it begins."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], list[int]]]:
    """Stretches of a batch in one block: file, block, lines, quotes in each."""
    for batch in batches:
        files, blocks, lines = (batch.column(c).to_pylist() for c in _LINES)
        quotes = pc.count_substring(batch.column("value"), '"').to_pylist()
        start = 0
        for at in range(1, len(lines) + 1):
            if at == len(lines) or files[at] != files[start] or blocks[at] != blocks[start]:
                yield files[start], blocks[start], lines[start:at], quotes[start:at]
                start = at


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: whether its quotes are odd in number, and if any line begins after an odd number."""
    facts: dict[tuple[str, int], list[bool]] = {}
    for file, block, _, quotes in _runs(batches):
        fact = facts.setdefault((file, block), [False, False])
        for n in quotes:
            fact[1] |= fact[0]
            fact[0] ^= bool(n & 1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([f for f, _ in facts], pa.string()),
            pa.array([b for _, b in facts], pa.int64()),
            pa.array([odd for odd, _ in facts.values()], pa.bool_()),
            pa.array([begins for _, begins in facts.values()], pa.bool_()),
        ],
        ["_file", "_block", "odd", "begins_odd"],
    )


def _begin_inside(lines: DataFrame) -> dict[tuple[str, int], int]:
    """Blocks that begin inside a record, and the block in which that record began.

    The driver holds two numbers per block of the input.
    """
    facts = materialize(lines.mapInArrow(_block_facts, "_file STRING, _block BIGINT, odd BOOLEAN, begins_odd BOOLEAN"), "blocks")
    order = Window.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    placed = facts.withColumn("inside", inside)
    # A block that begins outside has a record at its first line.
    begun = placed.withColumn("_begun", F.when(~F.col("inside") | F.col("begins_odd"), F.col("_block")))
    found = begun.withColumn("origin", F.last("_begun", ignorenulls=True).over(before))
    odd_files = facts.groupBy("_file").agg((F.sum(F.col("odd").cast("int")) % 2).alias("odd")).filter("odd = 1")
    for row in odd_files.limit(1).collect():
        raise ValueError(f"{row['_file']} has a quote without its other half; read it with cut=False")
    rows = found.filter("inside").select("_file", "_block", "origin").collect()
    return {(r["_file"], r["_block"]): r["origin"] for r in rows}


def _cutter(inside: dict[tuple[str, int], int]):
    """Records of a block as ``_file, _block, _row, part, text``; ``part`` is null where one is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, odd, held, first = None, 0, False, [], 0
        origin = None  # of the record that is being read, if it began in another block
        out: list[tuple] = []

        def rest() -> None:
            """What a block ends with, if it is inside a record."""
            if held:
                file, block = here
                began, row = (block, first) if origin is None else (origin, None)
                out.append((file, began, row, block, "\n".join(held)))
                held.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                ["_file", "_block", "_row", "part", "text"],
            )
            out.clear()

        for file, block, lines, quotes in _runs(batches):
            if (file, block) != here:
                rest()
                here, number, first = (file, block), 0, 0
                origin = inside.get(here)
                odd = origin is not None
            for line, n in zip(lines, quotes):
                if not held and origin is None:
                    first = number
                held.append(line)
                odd ^= bool(n & 1)
                number += 1
                if not odd:
                    text = "\n".join(held)
                    if origin is None:
                        out.append((file, block, first, None, text))
                    else:
                        out.append((file, origin, None, block, text))
                        origin = None
                    held.clear()
            yield from rows()
        rest()
        yield from rows()

    return run


def cut_csv(spark: SparkSession, paths: Sequence[str], header: Sequence[str]) -> DataFrame:
    """The records of plain CSV files with the same header line: its columns as text, and ``_file, _block, _row``.

    The rows are those of a reader that takes a file whole; ``_block`` and ``_row`` give the
    place at which a record begins.  A file with an odd number of quotes is an error.
    """
    lines = _lines(spark, paths)
    schema = "_file STRING, _block BIGINT, _row BIGINT, part BIGINT, text STRING"
    found = materialize(lines.mapInArrow(_cutter(_begin_inside(lines)), schema), "records")
    pieces = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = found.filter("part IS NOT NULL").groupBy("_file", "_block").agg(
        F.max("_row").alias("_row"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text")
    )
    whole = found.filter("part IS NULL").select("_file", "_block", "_row", "text")
    records = whole.unionByName(joined)
    # The first record of a file is its header; as it ends, so does every line of the file.
    header_row = (F.col("_block") == 0) & (F.col("_row") == 0)
    returns = [r["_file"] for r in records.filter(header_row & F.col("text").endswith("\r")).select("_file").collect()]
    plain = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    records = records.withColumn("text", F.when(F.col("_file").isin(returns), plain).otherwise(F.col("text")))
    records = records.filter(~header_row & (F.col("text") != ""))
    fields = ", ".join(f"`{name.replace('`', '``')}` STRING" for name in header)
    parsed = F.from_csv("text", fields, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.select(parsed.alias("_r"), "_file", "_block", "_row").select("_r.*", "_file", "_block", "_row")
