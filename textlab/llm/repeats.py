"""Removal of long repeated byte strings across all documents.

A byte goes when some string of 100 bytes that covers it also starts earlier in the corpus.
A suffix array of everything is not needed to find those strings, only the order of suffixes
that can share 100 bytes with another one:

1. Every window of 100 bytes has an anchor: the 28-byte string in it whose hash is smallest.
   Equal windows have equal anchors.  Neighbouring windows share theirs, so a document
   becomes a short row of blocks (runs of windows with one anchor).
2. Anchors that occur once are dropped.  Of equal blocks only the first stays open; all
   windows of the others are repeats.
3. Different blocks with one anchor may still share windows.  They are gathered in bundles
   of bounded size, and each bundle gets the order of its suffixes column by column: in each
   round one symbol of every string is inserted in front of its suffix, and order, last
   symbols (the transform) and common prefixes are brought up to date from those of the
   round before.  Neighbours with a common prefix of 100 are equal windows.
4. An anchor with more blocks than a bundle holds is split over bundles; the windows of its
   bundles are then merged by content.
5. What was found is put together per document, and the bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Length of the strings that must not repeat, and of the anchors in them.
LENGTH = 100
ANCHOR = 28
#: Text bytes of a task that are worked on at a time; longer texts are worked on alone.
PART_BYTES = 1 << 20
#: Strings in a bundle.
BUNDLE = 20_000
#: Documents that are looked at to find anchors too frequent for one task; how often an
#: anchor must be seen there; how many such anchors are shipped at most; into how many
#: groups each is split.  None of them changes the result.
HOT_SAMPLE, HOT_SEEN, HOT_ANCHORS, HOT_SPLIT = 8_000, 6, 20_000, 4_096

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POSITION_BITS = 22


def _inverse(factor: int) -> int:
    return pow(factor, -1, 1 << 64)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hasher:
    """Hashes of all strings of one length in a byte array."""

    def __init__(self, anchor: int):
        self.anchor = anchor
        self.table = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up = _powers(int(_FACTOR), n + 1)
            self.down = _powers(_inverse(int(_FACTOR)), n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        return _mix((sums[self.anchor :] - sums[: n + 1 - self.anchor]) * self.down[: n + 1 - self.anchor])


def _sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(-1, w)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def _blocks(hasher: _Hasher, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Blocks of texts of at least ``length`` bytes.

    Text number, start, offset of the anchor, number of windows, hash of the anchor, of the block.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    joined = b"".join(texts)
    with np.errstate(over="ignore"):
        grams = hasher(np.frombuffer(joined, np.uint8))
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    low = np.uint64((1 << _POSITION_BITS) - 1)
    width = length - hasher.anchor + 1
    found = []
    # Texts beyond the place's range are worked on in overlapping stretches.
    step = (1 << _POSITION_BITS) - length
    for at in range(0, max(1, len(joined) - length + 1), step):
        part = grams[at : at + step + width - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        found.append((_sliding_minimum(keys, width) & low).astype(np.int64) + at)
    anchors = np.concatenate(found)
    windows = np.arange(len(anchors))
    text = np.searchsorted(ends, windows, "right")
    valid = windows + length <= ends[np.minimum(text, len(ends) - 1)]
    windows, anchors, text = windows[valid], anchors[valid], text[valid]
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    count = np.diff(np.append(first, len(anchors)))
    begin = windows[first]
    view = memoryview(joined)
    digest = xxhash.xxh3_64_intdigest
    stop = (begin + count - 1 + length).tolist()
    contents = np.fromiter((digest(view[a:b]) for a, b in zip(begin.tolist(), stop)), np.uint64, len(begin))
    number = text[first]
    return number, begin - (ends - sizes)[number], anchors[first] - begin, count, grams[anchors[first]], contents


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts of at least ``length`` bytes, about ``PART_BYTES`` at a time."""
    ids, texts, held = [], [], 0
    for rows in slices(batches):
        for doc, text in zip(rows.column("_id").to_pylist(), rows.column("_text").to_pylist()):
            data = text.encode() if text else b""
            if len(data) < length:
                continue
            if held and held + len(data) > PART_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc)
            texts.append(data)
            held += len(data)
    if texts:
        yield ids, texts


def _block_reader(length: int, anchor: int, hot: np.ndarray | None):
    """Rows of blocks; without ``hot``, only their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(anchor)
        for ids, texts in _parts(batches, length):
            number, start, offset, count, anchors, contents = _blocks(hasher, texts, length)
            anchors = anchors.view(np.int64)
            if hot is None:
                yield pa.RecordBatch.from_pydict({"anchor": anchors})
                continue
            at = np.minimum(np.searchsorted(hot, anchors), max(0, len(hot) - 1))
            is_hot = hot[at] == anchors if len(hot) else np.zeros(len(anchors), bool)
            doc = np.array(ids, np.int64)[number]
            group = np.where(is_hot, 1 + (doc * 31 + start) % HOT_SPLIT, 0)
            # Start, offset and number of windows share a column, as the rows are shuffled.
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": anchors,
                    "split": group.astype(np.int32),
                    "block": contents.view(np.int64),
                    "doc": doc,
                    "place": start << 16 | offset << 8 | count,
                }
            )

    return run


def _start(place: str) -> Column:
    return F.shiftrightunsigned(place, 16)


def _windows(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(255))


def column_order(strings: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order and common prefixes of the suffixes of many strings, one column at a time.

    Strings stand right-aligned.  Round ``r`` inserts the r-th symbol from the right of every
    string that has one in front of its suffix.  The new order follows from the old one by
    a stable sort on the new symbols alone; the common prefix of two neighbours that begin
    alike is one more than the least one between their places before.  Yields, from round
    ``length`` on, the round, the numbers of the strings in order, and the common prefix of
    each with the one before (up to ``length``).
    """
    order = np.arange(len(strings))
    common = np.zeros(len(strings), np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    longest = int(sizes.max(initial=0))
    # Columns from the right, one row per round.
    table = np.zeros((longest, len(strings)), np.int16)
    for i, s in enumerate(strings):
        table[: len(s), i] = np.frombuffer(s, np.uint8)[::-1]
    for r in range(1, longest + 1):
        keep = sizes[order] >= r
        if not keep.all():
            # Strings that have ended leave; their neighbours keep what they have in common.
            common, order = _without(common, keep), order[keep]
        symbols = table[r - 1, order]
        move = np.argsort(symbols, kind="stable")
        same = np.concatenate(([False], symbols[move][1:] == symbols[move][:-1]))
        least = _range_minimum(common, move)
        order = order[move]
        common = np.where(same, np.minimum(least + 1, length), 0)
        if r >= length:
            yield r, order, common


def _without(common: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes of the neighbours that remain when some leave."""
    places = np.flatnonzero(keep)
    if not len(places):
        return common[:0]
    return np.minimum.reduceat(common[: places[-1] + 1], np.concatenate(([0], places[:-1] + 1)))


def _range_minimum(common: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each entry, the least common prefix after its predecessor's old place up to its own."""
    levels = [common]
    while len(levels[-1]) > 1 and 1 << len(levels) <= len(common):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.zeros(len(move), np.int64)
    lo, hi = move[:-1] + 1, move[1:] + 1
    span = np.maximum(hi - lo, 1)
    level = np.floor(np.log2(span)).astype(np.int64)
    for k in np.unique(level):
        own = np.flatnonzero((level == k) & (hi > lo))
        out[own + 1] = np.minimum(levels[k][lo[own]], levels[k][hi[own] - (1 << k)])
    return out


def _bundle_repeats(length: int):
    """Windows of a bundle that occur more than once in it, or (for split anchors) all of them."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks()
        strings = rows.column("content").to_pylist()
        doc = rows.column("doc").to_numpy()
        start = rows.column("start").to_numpy()
        anchor = rows.column("anchor").to_numpy()
        split = rows.column("split").to_numpy()
        # Distance from the right end of a string to its anchor: only windows that stand
        # alike to one anchor can be equal, so strings are aligned by it.
        shift = rows.column("after").to_numpy()
        closed_doc, closed_at, open_doc, open_at, open_key = [], [], [], [], []
        padded = [s + b"\0" * int(p) for s, p in zip(strings, shift.max(initial=0) - shift)]
        sizes = np.array([len(s) for s in strings], np.int64)
        full = np.array([len(s) for s in padded], np.int64)
        for r, order, common in column_order(padded, length):
            # The window of round r must lie in the string proper.
            inside = full[order] - r + length <= sizes[order]
            if not inside.any():
                continue
            common, order = _without(common, inside), order[inside]
            same = common >= length
            same[0] = False
            number = np.cumsum(~same)
            at = start[order] + full[order] - r
            # The first occurrence of each class by document, then place.
            by = np.lexsort((at, doc[order], number))
            heads = np.flatnonzero(np.concatenate(([True], number[by][1:] != number[by][:-1])))
            class_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(by))))
            head = by[heads][class_of]
            later = (doc[order[by]] != doc[order[head]]) | (at[by] != at[head])
            closed_doc.append(doc[order[by[later]]])
            closed_at.append(at[by[later]])
            # Of a split anchor, the first of each class meets those of other bundles.
            for i in by[heads[split[order[by[heads]]] > 0]].tolist():
                string = order[i]
                open_doc.append(int(doc[string]))
                open_at.append(int(at[i]))
                open_key.append(xxhash.xxh3_128_digest(strings[string][full[string] - r :][:length]))
        docs, begin, count = _runs(closed_doc, closed_at)
        return pa.table(
            {
                "doc": pa.array(np.concatenate((docs, np.array(open_doc, np.int64)))),
                "at": pa.array(np.concatenate((begin, np.array(open_at, np.int64)))),
                "count": pa.array(np.concatenate((count, np.ones(len(open_doc), np.int64)))),
                "window": pa.array([None] * len(docs) + open_key, pa.binary()),
            }
        )

    return run


def _runs(docs: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places of a document: document, first place, number."""
    if not docs:
        return (np.empty(0, np.int64),) * 3
    doc, place = np.concatenate(docs), np.concatenate(places)
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)))[: len(doc)])
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], place[first], place[last] - place[first] + 1 if len(doc) else place[:0]


def _content_reader(length: int):
    """The bytes of requested blocks."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            out = []
            for doc, text, wanted in zip(*(rows.column(c).to_pylist() for c in ("doc", "_text", "wanted"))):
                data = text.encode()
                for w in wanted:
                    start, offset, count = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    content = data[start : start + count - 1 + length]
                    out.append((w["anchor"], w["split"], doc, start, len(content) - offset, content))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                ["anchor", "split", "doc", "start", "after", "content"],
            )

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts ranges out of texts."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for rows in slices(batches, 64):
        sizes, spans, kept = [], [], []
        for text, ranges in zip(rows.column("_text").to_pylist(), rows.column("ranges").to_pylist()):
            data = text.encode() if text else b""
            merged: list[list[int]] = []
            for r in sorted(ranges or (), key=lambda r: r["first"]):
                if merged and r["first"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["last"])
                else:
                    merged.append([r["first"], r["last"]])
            edges = [0, *(e for m in merged for e in m), len(data)]
            sizes.append(len(data))
            spans.append([{"first": a, "last": b} for a, b in merged])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays(
            [rows.column("_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["_id", "n_bytes", "spans", "kept"],
        )


def _frequent_anchors(source: DataFrame, length: int, anchor: int) -> np.ndarray:
    """Anchors that a sample of documents sees often, ascending: at most ``HOT_ANCHORS``."""
    every = max(1, source.count() // HOT_SAMPLE)
    sample = source.filter(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0)
    seen = sample.mapInArrow(_block_reader(length, anchor, None), "anchor bigint").groupBy("anchor").count()
    rows = seen.filter(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "anchor").limit(HOT_ANCHORS).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def repeated_ranges(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """``doc, first, last``: byte ranges (end exclusive) of windows that also start earlier.

    Ranges of a document may overlap; their union is what repeats.
    """
    if not 8 <= anchor <= length <= anchor + 200:
        raise ValueError("an anchor has 8 bytes or more, and at most 200 fewer than the length")
    source = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hot = _frequent_anchors(source, length, anchor)
    schema = "anchor bigint, split int, block bigint, doc bigint, place bigint"
    blocks = source.mapInArrow(_block_reader(length, anchor, hot), schema)
    # Frequent anchors repeat for certain, so they are dealt out and not counted.
    times = F.count("*").over(Window.partitionBy("anchor", "split"))
    shared = materialize(blocks.withColumn("_n", times).filter("_n > 1 or split > 0").drop("_n", "split"), "blocks")

    where = F.struct("doc", "place")
    firsts = materialize(shared.groupBy("anchor", "block").agg(F.min(where).alias("head")), "firsts")
    later = shared.join(firsts, ["anchor", "block"]).filter((F.col("doc") != F.col("head.doc")) | (F.col("place") != F.col("head.place")))
    copies = later.select("doc", _start("place").alias("first"), (_start("place") + _windows("place") - 1 + length).alias("last"))

    # Anchors with different blocks: the first occurrence of each block is compared in bytes.
    several = materialize(firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "several")
    mixed = firsts.join(several, "anchor").select(
        "anchor",
        F.when(F.col("n") > BUNDLE, 1 + F.pmod(F.xxhash64("head.doc"), F.ceil(2 * F.col("n") / BUNDLE)))
        .otherwise(0)
        .alias("split"),
        F.col("head.doc").alias("doc"),
        F.col("head.place").alias("place"),
    )
    wanted = mixed.groupBy("doc").agg(F.collect_list(F.struct("anchor", "split", "place")).alias("wanted"))
    bundles = max(1, 2 * several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUNDLE)
    contents = (
        source.join(wanted, F.col("_id") == F.col("doc"))
        .select("doc", "_text", "wanted")
        .mapInArrow(
            _content_reader(length),
            "anchor bigint, split bigint, doc bigint, start bigint, after bigint, content binary",
        )
        .withColumn("bundle", F.pmod(F.xxhash64("anchor", "split"), F.lit(bundles)))
    )
    compared = materialize(
        contents.groupBy("bundle").applyInArrow(
            _bundle_repeats(length), "doc bigint, at bigint, count bigint, window binary"
        ),
        "windows",
    )
    # One row per window and bundle of a split anchor.
    same = Window.partitionBy("window").orderBy("doc", "at")
    across = compared.filter("window is not null").withColumn("_r", F.rank().over(same)).filter("_r > 1").drop("_r")
    windows = compared.filter("window is null").unionByName(across)
    return copies.unionByName(windows.select("doc", F.col("at").alias("first"), (F.col("at") + F.col("count") - 1 + length).alias("last")))


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """One row per document: ``id_col, n_bytes, spans, kept``.

    ``spans`` are the maximal byte ranges (end exclusive) that go, ``kept`` the bytes that
    stay, joined.  Earlier means a smaller id, or the same document and an earlier start;
    strings are judged on the texts as given, and never cross documents.  Null and empty
    texts, and texts shorter than ``length``, keep what they have.  Ids are integers; rows
    that repeat an id must repeat its text and count as one place.  An empty table gives an
    empty table.
    """
    found = repeated_ranges(docs, id_col=id_col, text_col=text_col, length=length, anchor=anchor)
    ranges = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = source.join(ranges, F.col("_id") == F.col("_doc"), "left").select("_id", "_text", "ranges")
    schema = f"_id {kind}, n_bytes bigint, spans array<struct<first:bigint,last:bigint>>, kept binary"
    return joined.mapInArrow(_cutter, schema).withColumnRenamed("_id", id_col)
