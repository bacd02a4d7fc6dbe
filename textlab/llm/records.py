"""Token ids as length-delimited binary records.

A shard ``records-NNNNNNNN.bin`` is a row of records, each framed as

    length          8 bytes, little-endian: bytes of data
    masked crc      4 bytes, of the length field
    data            one byte with the width of an id (2 or 4), then the ids,
                    little-endian unsigned
    masked crc      4 bytes, of the data

with the mask ``rotate_right(crc32, 15) + 0xA282EAD8`` (so that a checksum of data that holds
checksums stays sound).  Beside it ``records-NNNNNNNN.idx`` has one entry of 24 bytes per
record (document id, signed; offset of the record; number of ids), so that a reader can
visit records in any order.

Shards hold ascending ranges of document ids.  A shard is written under the name of its
attempt and renamed when complete, so a lost or repeated task leaves either nothing or the
same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from textlab.llm.batches import slices, worker_state
from textlab.llm.tokens import WordEncoder
from textlab.storage import materialize

#: Text bytes that go into a shard.
SHARD_BYTES = 64 * 1024 * 1024
#: Layout of an index entry.
_INDEX_ENTRY = "<qQQ"
_INDEX_BYTES = 24
_MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data))))


def pack_ids(ids: bytes) -> bytes:
    """Record data of little-endian unsigned 32-bit ids: 16-bit ones if they fit."""
    values = np.frombuffer(ids, "<u4")
    narrow = values.max(initial=0) < 1 << 16
    return b"\2" + values.astype("<u2").tobytes() if narrow else b"\4" + ids


def unpack_ids(data: bytes) -> bytes:
    """Ids of record data as little-endian unsigned 32-bit."""
    if data[0] == 4:
        return data[1:]
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


class CorruptRecord(ValueError):
    """A record whose checksum or length does not hold."""


def read_frame(stream) -> bytes | None:
    """The data of the next record, or None at the end of the stream."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise CorruptRecord("length of a record")
    data = stream.read(size := struct.unpack("<Q", head[:8])[0])
    tail = stream.read(4)
    if len(data) < size or len(tail) < 4 or masked_crc(data) != struct.unpack("<I", tail)[0]:
        raise CorruptRecord("data of a record")
    return data


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark resolves it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int,
    lower_words: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode every text, end it with ``end_id`` and write shards in ascending id order.

    Returns the stored manifest, a row per shard: ``shard, n_records, n_ids``.  Null and
    empty texts are a record with the end id only; rows that repeat an id are records of
    their own, in any order; an empty table leaves no shard.  A null id is an error.
    ``folder`` must be one that all executors reach.  ``tokenizer`` is a file that they have.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder)
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    shards = max(int(total // shard_bytes) + 1, min(spark.sparkContext.defaultParallelism, int(total >> 20) + 1))
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .repartitionByRange(shards, "_id")
        .sortWithinPartitions("_id")
    )
    schema = "shard bigint, n_records bigint, n_ids bigint"
    return materialize(ordered.mapInArrow(_writer(folder, tokenizer, end_id, lower_words), schema), "manifest")


def _writer(folder: str, tokenizer: str, end_id: int, lower_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"words-{tokenizer}", lambda: WordEncoder(tokenizer, lower_words, added_tokens=True))
        shard = TaskContext.get().partitionId()
        system, path = _file_system(folder)
        names = [f"{path}/records-{shard:08d}.{kind}" for kind in ("bin", "idx")]
        attempts = [f"{path}/.{uuid.uuid4().hex}" for _ in names]
        end = struct.pack("<I", end_id)
        offset = records = ids = 0
        body = index = None
        try:
            for rows in slices(batches):
                if body is None:
                    body, index = (system.open_output_stream(a) for a in attempts)
                for doc, text in zip(rows.column("_id").to_pylist(), rows.column("_text").to_pylist()):
                    if doc is None:
                        raise ValueError("a document without an id")
                    data = encoder.encode(text) + end
                    index.write(struct.pack(_INDEX_ENTRY, doc, offset, len(data) // 4))
                    body.write(record := frame(pack_ids(data)))
                    offset, records, ids = offset + len(record), records + 1, ids + len(data) // 4
        finally:
            for stream in (body, index):
                if stream is not None:
                    stream.close()
        if records:
            # The index goes last: a shard with an index is complete.
            for attempt, name in zip(attempts, names):
                system.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [records], "n_ids": [ids]})

    return run


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of a folder: ``doc_id, start, n_ids, ids`` (little-endian bytes).

    ``start`` counts the ids of all records before it.  The manifest is one row per shard, so
    its running total is small whatever the number of records.  Lengths, checksums and the
    index are verified; a fault stops the job.
    """
    folder = _qualified(spark, folder)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    # One shard per task: the manifest is dealt out again after its running total.
    tasks = max(1, manifest.count())
    schema = "doc_id bigint, start bigint, n_ids bigint, ids binary"
    return placed.repartitionByRange(tasks, "shard").mapInArrow(_reader(folder), schema)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        for rows in batches:
            for shard, start in zip(rows.column("shard").to_pylist(), rows.column("before").to_pylist()):
                name = f"{path}/records-{shard:08d}"
                with system.open_input_stream(f"{name}.bin") as body, system.open_input_stream(f"{name}.idx") as index:
                    at, found, held = 0, [], 0
                    while entry := index.read(_INDEX_BYTES):
                        doc, offset, n = struct.unpack(_INDEX_ENTRY, entry)
                        data = read_frame(body)
                        if data is None or offset != at:
                            raise CorruptRecord(f"{name} does not fit its index")
                        at += len(data) + 16
                        data = unpack_ids(data)
                        if len(data) != 4 * n:
                            raise CorruptRecord(f"{name} does not fit its index")
                        found.append((doc, start, n, data))
                        start, held = start + n, held + len(data)
                        if held > 4 << 20:
                            yield _as_batch(found)
                            found, held = [], 0
                    if read_frame(body) is not None:
                        raise CorruptRecord(f"{name} has records without index")
                    yield _as_batch(found)

    return run


def _as_batch(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in found], kind) for i, kind in enumerate(types)], ["doc_id", "start", "n_ids", "ids"]
    )


def record_places(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of a folder as rows: ``shard, doc_id, offset, n_ids``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "records-*.idx").load(_qualified(spark, folder))
    shard = F.regexp_extract("path", r"records-(\d+)\.idx$", 1).cast("bigint").alias("shard")
    schema = "shard bigint, doc_id bigint, offset bigint, n_ids bigint"

    def unpack(batches):
        for rows in batches:
            for which, content in zip(rows.column("shard").to_pylist(), rows.column("content").to_pylist()):
                table = np.frombuffer(content, "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(table), which)), *(pa.array(np.ascontiguousarray(c)) for c in table.T)],
                    ["shard", "doc_id", "offset", "n_ids"],
                )

    return files.select(shard, "content").mapInArrow(unpack, schema)


def read_shuffled(spark: SparkSession, folder: str, seed: int, partitions: int | None = None) -> DataFrame:
    """Records in a seeded random order across and within tasks, fetched by their offsets.

    Only index entries are shuffled; a task then reads its records where they lie.
    Returns ``doc_id, n_ids, ids``.
    """
    qualified = _qualified(spark, folder)
    order = F.xxhash64(F.lit(seed), "shard", "offset")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = record_places(spark, folder).withColumn("_order", order).repartition(n, "_order").sortWithinPartitions("_order")

    def fetch(batches):
        system, path = _file_system(qualified)
        for batch in slices(batches):
            found = []
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/records-{row['shard']:08d}.bin") as body:
                    body.seek(row["offset"])
                    found.append((row["doc_id"], row["n_ids"], unpack_ids(read_frame(body))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "n_ids", "ids"],
            )

    return dealt.mapInArrow(fetch, "doc_id bigint, n_ids bigint, ids binary")
