"""Exact ranks over large tables without sorting them in one place.

Seeded selection ("the first n rows of each stratum in hash order") never ranks every
row.  Rows are counted per hash prefix, the prefix in which the n-th row falls is found
from the counts, only that prefix is sorted, and its n-th key becomes a *cut*.  Applying
a cut is a comparison on each row, so the table itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.text import seeded_hash
from textlab.storage import materialize, scratch_path, stored_bytes

# Hex digits that form a counting prefix: 16**4 = 65,536 prefixes per stratum, so the one
# that has to be sorted holds about 1/65,536 of its stratum.
PREFIX_DIGITS = 4

# Compressed input per range of a range sort: no less than the first while there are fewer
# ranges than shuffle partitions, no more than the second in any case.
SMALL_RANGE_BYTES = 4 * 1024 * 1024
RANGE_BYTES = 256 * 1024 * 1024


def with_hash_key(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Add ``_key``: the row's place in the seeded order, ties impossible as ids are unique."""
    key = F.struct(seeded_hash(F.col(id_col), seed).alias("h"), F.col(id_col).cast("string").alias("id"))
    return df.withColumn("_key", key)


def _keyed(df: DataFrame, strata: Sequence[str], id_col: str, seed: int, digits: int) -> DataFrame:
    keyed = with_hash_key(df.select(*strata, id_col), id_col, seed)
    return keyed.withColumn("_prefix", F.substring("_key.h", 1, digits))


def prefix_counts(
    df: DataFrame, *, strata: Sequence[str], id_col: str = "id", seed: int, digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Rows per stratum and hash prefix, stored: at most 16**digits rows per stratum.

    One read of the table answers both how large the strata are and where a rank falls.
    """
    keyed = _keyed(df, strata, id_col, seed, digits)
    return materialize(keyed.groupBy(*strata, "_prefix").agg(F.count("*").alias("_count")), "counts")


def hash_cuts(
    df: DataFrame,
    counts: DataFrame,
    targets: DataFrame,
    *,
    strata: Sequence[str],
    id_col: str = "id",
    seed: int,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """The key of the n-th row, in seeded order, of each stratum.

    See :func:`cuts_of_keys`, which this calls with the keys of ``df``.
    """
    holding = holding_prefixes(counts, targets, strata)
    return cuts_of_keys(_keyed(df, strata, id_col, seed, digits), holding, strata)


def holding_prefixes(counts: DataFrame, targets: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``*strata, name, _prefix, _nth``: the prefix that holds the wanted row, and its place there.

    ``counts`` is the table's :func:`prefix_counts`.  ``targets`` has the strata columns,
    ``name`` and ``n``; it is a report-sized table (one row per stratum and name).  The
    result has ``cut`` in place of ``n``.  A target beyond the stratum's size gives its last
    key, a target of zero gives no row.
    """
    strata = list(strata)
    by_prefix = Window.partitionBy(*strata).orderBy("_prefix")
    placed = counts.withColumn("_upto", F.sum("_count").over(by_prefix)).withColumn(
        "_size", F.sum("_count").over(Window.partitionBy(*strata))
    )
    wanted = F.least(F.col("n"), F.col("_size"))
    before = F.col("_upto") - F.col("_count")
    pairs = placed.join(F.broadcast(targets), strata) if strata else _pair_all(placed, targets)
    holding = pairs.filter((before < wanted) & (wanted <= F.col("_upto"))).select(
        *strata, "name", "_prefix", (wanted - before).alias("_nth")
    )
    return holding


def cuts_of_keys(keyed: DataFrame, holding: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``*strata, name, cut`` from rows with ``*strata, _prefix, _key``; other prefixes are not looked at."""
    strata = list(strata)
    # At most one row per target, whatever the size of the table.
    candidates = keyed.join(F.broadcast(holding), [*strata, "_prefix"])
    order = Window.partitionBy(*strata, "name").orderBy("_key")
    return (
        candidates.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_nth"))
        .select(*strata, "name", F.col("_key").alias("cut"))
    )


def _pair_all(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Without strata every prefix count meets every target: both tables are report-sized."""
    listed = targets.agg(F.collect_list(F.struct("name", "n")).alias("t"))
    return counts.withColumn("_t", F.explode(listed.scalar())).select("*", "_t.name", "_t.n").drop("_t")


def within(key: Column, cut: Column) -> Column:
    """Whether a row's key is at or before a cut; no cut admits nothing."""
    return F.coalesce(key <= cut, F.lit(False))


def hash_rank(
    df: DataFrame, *, strata: Sequence[str] = (), id_col: str = "id", seed: int, digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Exact 1-based rank of every row in the seeded order of its stratum.

    One shuffle on (stratum, hash prefix): the prefixes are even by construction, so no
    task holds more than a sliver of a stratum.
    """
    strata = list(strata)
    keyed = with_hash_key(df, id_col, seed).withColumn("_prefix", F.substring("_key.h", 1, digits))
    by_prefix = Window.partitionBy(*strata).orderBy("_prefix")
    offsets = (
        keyed.groupBy(*strata, "_prefix")
        .agg(F.count("*").alias("_count"))
        .withColumn("_before", F.sum("_count").over(by_prefix) - F.col("_count"))
        .drop("_count")
        .withColumnsRenamed({c: f"_o_{c}" for c in [*strata, "_prefix"]})
    )
    # A null stratum is a stratum like any other.
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*strata, "_prefix"]]
    inside = Window.partitionBy(*strata, "_prefix").orderBy("_key")
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn("rank", F.col("_before") + F.col("_place"))
        .drop("_key", "_prefix", "_place", "_before", *[f"_o_{c}" for c in [*strata, "_prefix"]])
    )


def dense_ids(
    df: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of a unique sort key.

    The rows are range-sorted into files once (balanced, because the key is unique) and
    numbered by where they lie: rows in earlier files plus the position in the file.
    With ``order_by=None`` they keep the order of the input's partitions, without any
    shuffle.  The copy lies in the shared folder, so every later read sees the same ids.

    A range sort runs its input twice, once to sample the key, so the input is written down
    first; the size of that copy decides into how many ranges it is sorted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    if order_by is not None:
        staged = scratch_path(spark, "staged")
        df.write.parquet(staged)
        size = stored_bytes(spark, staged)
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(1, min(usual, size // SMALL_RANGE_BYTES), size // RANGE_BYTES)
        df = (
            spark.read.schema(df.schema)
            .parquet(staged)
            .repartitionByRange(ranges, *order_by)
            .sortWithinPartitions(*order_by)
        )
    df.write.parquet(path)
    stored = (
        spark.read.schema(df.schema)
        .parquet(path)
        .select("*", F.col("_metadata.file_name").alias("_part_file"), F.col("_metadata.row_index").alias("_part_row"))
    )
    # One row per file: bounded by the number of write tasks, whatever the row count.
    files = stored.groupBy("_part_file").agg(F.count("*").alias("_part_rows"))
    # Task numbers are compared as numbers: beyond 99,999 their padded names no longer sort.
    task = F.regexp_extract("_part_file", r"^part-(\d+)", 1).cast("bigint")
    before = F.sum("_part_rows").over(Window.orderBy(task, "_part_file")) - F.col("_part_rows")
    offsets = materialize(files.select("_part_file", before.alias("_part_before")), "offsets")
    columns = [c for c in df.columns if c != id_col]
    return stored.join(F.broadcast(offsets), "_part_file").select(
        (F.col("_part_before") + F.col("_part_row")).alias(id_col), *columns
    )
