"""Benchmark decontamination: a broadcast hash set of test n-grams against all token windows.

The n-grams of the test set are collected in blocks of bounded size and shipped to the
tasks, which walk every document once per block.  A window is looked up by hash and verified
word by word.  Documents never move.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Words in a window.
WINDOW = 13
#: Text bytes of test items that are shipped to the tasks at a time.
BLOCK_BYTES = 16 * 1024 * 1024

# Words are letters, digits and everything beyond ASCII; A-Z count as a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_SCHEMA = "n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<bigint>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character positions of the words of :func:`words`, end exclusive."""
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


class NgramSet:
    """The windows of some test items, by length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                windows[n][tuple(ids[at : at + n])].add(item)
        self.windows = {n: {k: tuple(v) for k, v in found.items()} for n, found in windows.items()}
        self.hashes = {n: np.unique(self._hash(np.array(list(found), np.int64))) for n, found in self.windows.items()}

    @staticmethod
    def _hash(ids: np.ndarray) -> np.ndarray:
        """Hashes of the rows of a matrix of word numbers."""
        out = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            for column in range(ids.shape[1]):
                out = (out + ids[:, column].astype(np.uint64) + np.uint64(1)) * _BASE
        return out

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, word ranges (end exclusive, merged) inside a test window, and their items."""
        listed = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)[starts]
            likely = np.isin(self._hash(rows), hashes)
            table = self.windows[n]
            for at, row in zip(starts[likely].tolist(), rows[likely].tolist()):
                if found := table.get(tuple(row)):
                    spans.append((at, at + n))
                    items.update(found)
        return len(listed), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The test items in blocks whose texts fill ``block_bytes`` or are a single item."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= block_bytes:
        return [items]
    # Blocks by hash of the item: about half full on average, so that the fullest one fits.
    n = int(2 * total // block_bytes) + 1
    stored = materialize(items.select(item_col, text_col, F.pmod(F.xxhash64(item_col), F.lit(n)).alias("_block")), "items")
    return [stored.filter(F.col("_block") == i) for i in range(n)]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col, n_words, hits, items``.

    ``hits`` are the merged word ranges (end exclusive) that lie in an occurrence of a window
    of a test item, ``items`` the ids of the items whose windows occur, ascending.  An item
    shorter than a window is one window; an item without words has none.  Null and empty
    documents have no words and no hits.  Rows that repeat an id, or have none, are rows of
    their own.  Empty tables are fine on both sides.

    A test set beyond ``block_bytes`` is taken in blocks, each against all documents; the
    findings of a block are stored before the next one is fetched, and then put together per row.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(items, item_col, text_col, block_bytes)
    fetch = lambda block: [tuple(r) for r in block.select(item_col, text_col).toLocalIterator()]
    if len(blocks) == 1:
        found = source.mapInArrow(_finder(NgramSet(fetch(blocks[0]), window)), f"_id {kind}, {_SCHEMA}")
        return found.withColumnRenamed("_id", id_col)
    # Stored, so that a row keeps its number.
    numbered = materialize(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    asked = numbered.select(F.col("_row").alias("_id"), "_text")
    results = []
    for block in blocks:
        if listed := fetch(block):
            results.append(materialize(asked.mapInArrow(_finder(NgramSet(listed, window)), f"_id bigint, {_SCHEMA}"), "hits"))
    merged = reduce(DataFrame.unionByName, results).groupBy(F.col("_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = merged.select("_row", "n_words", _merged_column("hits").alias("hits"), "items")
    return numbered.select("_row", F.col("_id").alias(id_col)).join(merged, "_row").drop("_row")


def _merged_column(name: str):
    """Ranges of several blocks, joined where they overlap or touch."""
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def add(out, span):
        last = F.element_at(out, -1)
        joined = F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))),
        )
        apart = F.concat(out, F.array(span))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["last"] >= span["first"]), joined).otherwise(apart)

    return F.aggregate(F.array_sort(name), empty, add)


def _finder(ngrams: NgramSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            results = [ngrams.find(t) for t in rows.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "_id": rows.column("_id"),
                    "n_words": pa.array([r[0] for r in results], pa.int64()),
                    "hits": pa.array(
                        [[{"first": a, "last": b} for a, b in r[1]] for r in results],
                        pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
                    ),
                    "items": pa.array([sorted(r[2]) for r in results], pa.list_(pa.int64())),
                }
            )

    return run


def hit_words(hits: str = "hits"):
    """Number of words inside the hits of a row."""
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"])


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words lies in test windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without contamination: whole documents, or only the spans found in them.

    ``remove="documents"`` drops the documents of which a twentieth or more is hit;
    ``"spans"`` cuts the hit words, and what stands between them, out of every text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = contamination(docs, items, id_col=id_col, text_col=text_col).filter(F.size("hits") > 0)
    found = found.dropDuplicates([id_col])
    if remove == "documents":
        bad = found.filter(is_contaminated(hit_words(), F.col("n_words"))).select(F.col(id_col).alias("_hit_id"))
        return docs.join(bad, docs[id_col].eqNullSafe(bad["_hit_id"]), "left_anti")
    found = found.select(F.col(id_col).alias("_hit_id"), F.col("hits").alias("_hit_ranges"))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_hit_id"]), "left")
    cut = F.when(F.col("_hit_ranges").isNull(), F.col(text_col)).otherwise(_cut(text_col, "_hit_ranges"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _cut(text_col: str, hits: str):
    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, ranges in zip(texts, spans):
            if ranges is None or text is None:
                out.append(text)
                continue
            at, kept = 0, []
            places = word_spans(text)
            for h in ranges:
                kept.append(text[at : places[h["first"]][0]])
                at = places[h["last"] - 1][1]
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out)

    return cut(F.col(text_col), F.col(hits))
