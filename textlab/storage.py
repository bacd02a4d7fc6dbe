"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local-mode
    session without that setting falls back to a temporary folder, because there
    driver and executors are one process on one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="textlab-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files in a folder, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def materialize(
    df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """Write ``df`` once and return a reader of the copy.

    Cuts lineage in a way that survives lost executors, and lets a table that an
    operator reads several times be computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer = writer.option("compression", compression) if compression else writer
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark resolves it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return found if "://" in found else found.replace("file:/", "file:///", 1)


def file_system(uri: str):
    """pyarrow's file system for a qualified path, and the path in it.  Runs in tasks too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Batches:
    """Tables in a folder that grow by named batches.

    ``log`` has a line for each batch, with its name and what its writer notes.  It is written
    when all tables of a batch are, so a batch that failed half-way is never read and is
    written over when it comes again; one that is in the log is not written again.  One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, note: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._schema = f"batch STRING, {note}"

    def log(self) -> list:
        """A row per batch: one for each time that something was added."""
        try:
            return self.spark.read.schema(self._schema).parquet(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def holds(self, batch: str) -> bool:
        return any(row["batch"] == batch for row in self.log())

    def folder(self, table: str, batch: str) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def write(self, table: str, batch: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """A table of a batch that is not in the log yet; gives a reader of the copy."""
        path = self.folder(table, batch)
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, batch: str, *note) -> None:
        line = self.spark.createDataFrame([(batch, *note)], self._schema)
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def read(self, table: str, schema, batches: Sequence[str] | None = None) -> DataFrame:
        """Rows of the batches in the log, or of some of them."""
        known = sorted({row["batch"] for row in self.log()})
        wanted = [b for b in known if batches is None or b in batches]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [self.folder(table, b) for b in wanted]
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return found.drop("batch")
