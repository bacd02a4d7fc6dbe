"""Near-duplicates by min-max hashing.

Each permutation of the shingles gives two signature values, the smallest and the largest
one, so a signature costs half the hash evaluations of plain MinHash.  Bands of minima and
bands of maxima propose pairs; every link is confirmed on the full shingle sets.

Equal sets are one class from the start, so copies never meet each other.  A bucket of a
band is compared with one pivot, never pairwise.  Where that leaves members in different
components, they meet once more by their rarest shingles: linked sets share one of those, at
places that both allow (see :func:`_apart`).  No link between proposed pairs is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Link documents with 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Words in a shingle.
SHINGLE = 3
#: Values in a band and number of bands (half of minima, half of maxima).  A pair at the
#: threshold is proposed with probability 1 - (1 - 0.85 ** 6) ** 28 = 0.999998.
BAND = 6
BANDS = 28
#: Members of a bucket of rare shingles that are held against as many others at a time.
BLOCK = 2048

_SEED = 20_011


def _constants(n: int, salt: int) -> np.ndarray:
    """Odd 64-bit multipliers that follow from a seed."""
    return np.array([xxhash.xxh64_intdigest(f"{salt}:{i}".encode(), _SEED) | 1 for i in range(n)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs of characters other than ASCII white space, A-Z as a-z.  A text of fewer
    words is one shingle, a text without words has none.
    """
    listed = text.encode().lower().split() if text else []
    if not listed:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))
        n = min(words, len(hashed))
        factors = _constants(n, n)
        out = hashed[: len(hashed) - n + 1] * factors[0]
        for i in range(1, n):
            out = _mix(out) + hashed[i : len(hashed) - n + 1 + i] * factors[i]
        return np.unique(_mix(out))


def bands(sets: list[np.ndarray], band: int = BAND, count: int = BANDS) -> np.ndarray:
    """Band keys of non-empty sets: a row of ``count`` 64-bit keys for each.

    The first half of the keys is made of minima, the second of maxima of the same
    permutations; permutations are not shared within a key.
    """
    half = count // 2
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    out = np.empty((len(sets), count), np.uint64)
    factors, shifts = _constants(half * band, 101), _constants(half * band, 102)
    with np.errstate(over="ignore"):
        for key in range(half):
            low = np.full(len(sets), key, np.uint64)
            high = np.full(len(sets), half + key, np.uint64)
            for i in range(key * band, (key + 1) * band):
                order = (values ^ shifts[i]) * factors[i]
                low = _mix(low * factors[0] + np.minimum.reduceat(order, starts))
                high = _mix(high * factors[0] + np.maximum.reduceat(order, starts))
            out[:, key], out[:, half + key] = low, high
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (a.size + b.size - both)


def _signer(words: int, band: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingles(t, words) for t in rows.column("_text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list[list[int] | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, bands([sets[i] for i in full], band, count).view(np.int64).tolist()):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["_id", "n", "set_key", "bands"],
            )

    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingles(t, words).tobytes() for t in rows.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices([batch]):
                pairs = zip(rows.column("a_set").to_pylist(), rows.column("b_set").to_pylist())
                keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with both shingle sets; the side that many pairs share is joined last.

    Pairs and sets both grow with the corpus, so neither is shipped whole.
    """
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("set").alias(f"{name}_set")).hint("merge")
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = _with_sets(pairs, sets).select("a", "b", "a_set", "b_set")
    return joined.mapInArrow(_verifier(percent), "a bigint, b bigint")


def _apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` among ``rep, n, component`` that may be linked and are in different components.

    Shingles are ordered from the rarest to the most common among the members.  Linked sets x
    and y share at least s = percent / (100 + percent) * (|x| + |y|) shingles, and all that stands
    before their first common one in x is not in y.  So at most |x| - s stand before it in x,
    at most |y| - s in y, and it is among the first |x| - percent / 100 * |x| + 1 of x whatever
    the size of y.  What a whole group has in common comes last in the order and seldom
    brings two of its members together.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            listed = [np.frombuffer(s, np.int64) for s in rows.column("set").to_pylist()]
            each = pa.array(np.repeat(np.arange(len(listed)), [len(x) for x in listed]))
            flat = pa.array(np.concatenate(listed) if listed else np.empty(0, np.int64))
            others = [rows.column(c).take(each) for c in ("rep", "n", "component")]
            yield pa.RecordBatch.from_arrays([flat, *others], ["bucket", "rep", "n", "component"])

    schema = "bucket bigint, rep bigint, n bigint, component bigint"
    held = members.join(sets.hint("merge"), "rep").select("rep", "n", "component", "set").mapInArrow(elements, schema)
    held = materialize(held, "elements")
    # A bucket with a single component has nothing to bring together, but counts in the order.
    common = held.groupBy("bucket").agg(
        F.count("*").alias("c"), F.min("component").alias("_lo"), F.max("component").alias("_hi")
    )
    common = materialize(common.filter("c > 1"), "common")
    own = Window.partitionBy("rep")
    # Shingles that nobody shares come first in the order, and are not among the rows.
    before = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "bucket")) - 1
    placed = held.join(common, "bucket").withColumn("before", before)
    placed = placed.filter((100 * F.col("before") <= (100 - percent) * F.col("n")) & (F.col("_lo") < F.col("_hi")))
    placed = materialize(placed.select("bucket", "rep", "n", "component", "before"), "placed")
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(materialize(sizes, "sizes"), "bucket")
    # Block i meets block j in the group (i, j), i <= j.
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("_mine", mine).withColumn("_other", other)
    placed = placed.withColumns({"i": F.least("_mine", "_other"), "j": F.greatest("_mine", "_other")})

    def meet(rows: pa.Table) -> pa.Table:
        rep, n, component, before, block = (
            rows.column(c).to_numpy() for c in ("rep", "n", "component", "before", "_mine")
        )
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in left.tolist():
            y = right[right > x] if i == j else right
            both = n[x] + n[y]
            good = (component[y] != component[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            good &= (100 + percent) * (n[x] - before[x]) >= percent * both
            good &= (100 + percent) * (n[y] - before[y]) >= percent * both
            y = y[good]
            found.append(np.stack((np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]))))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    grouped = placed.select("bucket", "i", "j", "rep", "n", "component", "before", "_mine").groupBy("bucket", "i", "j")
    return grouped.applyInArrow(meet, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """``rep, component`` for every end of a link ``a, b``: the smallest id it reaches.

    Alternates two steps that hang every neighbour on the smallest one, first the larger
    neighbours of a vertex, then the smaller ones, until all hang on the smallest of all.  Each step is an
    aggregation and a join, so a vertex with any number of links is never held in one place.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = materialize(small.select("e.u", "e.v").filter("u > v").distinct(), "links")
        # Done when every vertex hangs on one other that hangs on none.
        several = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        chained = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if several.union(chained).isEmpty():
            break
    ends = edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct())


def _stars(rows: DataFrame) -> DataFrame:
    """``bucket, rep, n, pop`` with the bucket's size and its pivot.

    The pivot is the member with the most company in its other buckets: in a group of
    variants that is the one in the middle.
    """
    best = rows.groupBy("bucket").agg(
        F.count("*").alias("size"), F.max(F.struct("pop", (-F.col("rep")).alias("r"), "n")).alias("best")
    )
    best = best.select("bucket", "size", (-F.col("best.r")).alias("pivot"), F.col("best.n").alias("pivot_n"))
    # Stored, so that the join may split the rows of a large bucket.
    return rows.join(materialize(best, "pivots"), "bucket")


def _comparable(n, m, percent: int):
    """Whether the sizes of two sets allow a link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _open(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are not all in one component, with the component."""
    placed = rows.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return placed.join(materialize(spread.filter("_lo < _hi").select("bucket"), "spread"), "bucket")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    words: int = SHINGLE,
    band: int = BAND,
    count: int = BANDS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that a document reaches over links, ``kept`` whether
    that is its own.  Null and empty texts have no shingles and are linked with nothing;
    rows that repeat an id are one document if their texts have equal sets.  Other columns
    are not looked at; an empty table gives an empty table.  Ids are integers; a null id is
    an error.
    """
    if not 67 < percent <= 100:
        raise ValueError("percent lies between 68 and 100")
    source = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    source = source.withColumn("_id", F.when(F.col("_id").isNull(), F.raise_error(F.lit("a null id")).cast("bigint")).otherwise(F.col("_id")))
    signed = materialize(
        source.mapInArrow(_signer(words, band, count), "_id bigint, n bigint, set_key binary, bands array<bigint>"),
        "signatures",
    )
    classes = signed.filter("n > 0").groupBy("set_key").agg(
        F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = materialize(classes, "classes")

    # The bands carry their number in the key, so a key alone is a bucket.
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = materialize(members.join(shared, "bucket"), "members")
    popular = materialize(members.groupBy("rep").agg(F.sum("size").alias("pop")), "popular")
    rows = materialize(_stars(members.drop("size").join(popular, "rep")), "stars")
    sizes = classes.select("rep", "n")
    pairs = (
        rows.filter((F.col("rep") != F.col("pivot")) & _comparable(F.col("n"), F.col("pivot_n"), percent))
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    pairs = materialize(pairs, "pairs")

    def sets_of(numbers: DataFrame) -> DataFrame:
        wanted = source.join(numbers.distinct().hint("merge"), source["_id"] == F.col("rep"), "left_semi")
        return materialize(wanted.mapInArrow(_setter(words), "rep bigint, set binary"), "sets")

    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    links = materialize(_verified(pairs, sets_of(ends), percent), "found")
    # Of two members one is the pivot, and they were compared.
    left = _open(rows.filter("size > 2").select("bucket", "rep"), components(links))
    left = materialize(left.select("rep", "component").distinct().join(sizes, "rep"), "left")
    if not left.isEmpty():
        sets = sets_of(left.select("rep"))
        links = links.union(materialize(_verified(_apart(left, sets, percent), sets, percent), "found"))

    merged = components(links)
    of_class = classes.select("set_key", "rep").join(merged, "rep", "left")
    of_class = materialize(of_class.select("set_key", F.coalesce("component", "rep").alias("_component")), "of_class")
    own = signed.select("_id", "n", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce("_component", "_id")
    kind = docs.schema[id_col].dataType
    return own.select(
        F.col("_id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept")
    kept = kept.select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")
