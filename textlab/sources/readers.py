"""Raw and normalized inputs as DataFrames.  Values of raw files stay strings."""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textlab.sources.csv_cut import cut_csv

CORPUS_SCHEMA = (
    "id BIGINT, text STRING, label STRING, source_model STRING, platform STRING, dataset STRING"
)
ANSWERS_SCHEMA = "human_answers ARRAY<STRING>, chatgpt_answers ARRAY<STRING>"
EMBEDDING_SCHEMA = "id BIGINT, embedding ARRAY<FLOAT>"

# Where a row was read: file, block of the file, place within the block.  In this order the
# three give the order of the rows in the sorted files.
ORDER_COLUMNS = ("_file", "_block", "_row")


def with_scan_order(df: DataFrame) -> DataFrame:
    """Add :data:`ORDER_COLUMNS` to a file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a few large files out to all cores before costly work on them.

    A file that cannot be split is one task, however many cores there are.  With at least
    as many files as cores the rows stay where they are, so a large table is not shuffled.
    ``keys`` identify a row; hashing them gives the same tasks again after a failure.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Files that can be split are more partitions than files already.
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def list_files(spark: SparkSession, folder: str, *globs: str) -> list[str]:
    """Paths in ``folder`` that match one of the name patterns, sorted; none if it is absent."""
    found: set[str] = set()
    for glob in globs:
        try:
            found.update(spark.read.option("pathGlobFilter", glob).text(folder).inputFiles())
        except AnalysisException as error:
            if not _is_missing(error):
                raise
    # Spark lists encoded names, and reads names as patterns.
    return sorted(unquote(name) for name in found)


def literal(path: str) -> str:
    """A path that stands for itself where a pattern may stand."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def header_names(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a CSV file; of names that differ only in case, later ones get a number."""
    line = spark.read.text(literal(path)).head()
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(next(csv.reader([line[0].lstrip("\ufeff")])) if line else ()):
        name = name or f"_c{i}"
        again = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if again == 1 else f"{name}__{again}")
    return tuple(names)


def _csv(spark: SparkSession, multiline: bool):
    # Doubled quotes are the escape; quoted line breaks need whole-file (multiLine) reading.
    return (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )


def read_csv_folder(
    spark: SparkSession, folder: str, *, globs=("*.csv", "*.csv.gz"), multiline: bool = True, cut: bool = True
) -> list[DataFrame]:
    """One DataFrame per distinct header among the CSV files of a folder; none, and a warning, without files.

    Files with the same header share a scan, so the plan grows with the number of layouts
    and not with the number of files.  Plain files are cut into records wherever a task begins
    (see ``csv_cut``); ``cut=False`` reads each whole, for files with quotes of another kind.
    ``multiline=False`` is for data known to have no quoted line breaks.  A compressed file
    is one task in any case.  Few files are dealt out to all cores.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in list_files(spark, folder, *globs):
        header = header_names(spark, path)
        if header:  # an empty file has none
            by_header.setdefault(header, []).append(literal(path))
    if not by_header:
        warnings.warn(f"no files {', '.join(globs)} with a header in {folder}", stacklevel=2)
    tables = []
    for header, paths in by_header.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        plain = [p for p in paths if p.endswith(".csv")] if multiline and cut else []
        whole = [p for p in paths if p not in plain]
        parts = [cut_csv(spark, plain, header)] if plain else []
        if whole:
            parts.append(spread(with_scan_order(_csv(spark, multiline).schema(schema).csv(whole)), *ORDER_COLUMNS))
        tables.append(reduce(DataFrame.unionByName, parts))
    return tables


def read_csv(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame | None:
    """A single CSV file, or None, and a warning, if it is absent."""
    try:
        return spread(with_scan_order(_csv(spark, multiline).csv(path)), *ORDER_COLUMNS)
    except AnalysisException as error:
        if _is_missing(error):
            warnings.warn(f"no file {path}", stacklevel=2)
            return None
        raise


def read_answers(spark: SparkSession, path: str, schema: str = ANSWERS_SCHEMA) -> DataFrame:
    """Question records with arrays of answers; no rows if the file is absent."""
    try:
        return with_scan_order(spark.read.schema(schema).json(path))
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        order = "_file STRING, _block BIGINT, _row BIGINT"
        return spark.createDataFrame([], f"{schema}, {order}")


def read_corpus(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """A normalized corpus, as JSON lines or parquet."""
    return spark.read.schema(CORPUS_SCHEMA).format(format).load(path)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Written instruction records.  The schema is given: finding it would read the whole folder once more."""
    return spark.read.schema("instruction STRING, output STRING, split STRING, variant STRING").json(path)


# An entry of a split map between two separators, with the braces of the map at its ends.
_ENTRY = r'^\s*\{?\s*"([^"\\]*)"\s*:\s*"([^"\\]*)"\s*\}?\s*$'


def read_split_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{"id": "split", ...}``, or a folder of them, as rows.

    The text is cut at the separator of entries, so one large object is read by many tasks.
    Ids are whole numbers and names of splits are plain words; an entry that is not of this
    form (a quoted comma, an escape, a value that is no text) is an error.
    """
    pieces = spark.read.option("lineSep", ",").text(path)
    blank = F.col("value").rlike(r"^[\s{}]*$")
    entry = F.regexp_extract("value", _ENTRY, 1), F.regexp_extract("value", _ENTRY, 2)
    strange = F.raise_error(F.concat(F.lit("not an entry of a split map: "), F.substring("value", 1, 100)))
    number = F.when(F.col("value").rlike(_ENTRY), entry[0].cast("bigint")).otherwise(strange.cast("bigint"))
    return pieces.filter(~blank).select(number.alias("id"), entry[1].alias("split"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def flatten_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """All splits of a dataset after one another, in the order of the mapping."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits.values())
