"""Quality classification by importance resampling with hashed n-gram models.

Two bags of hashed unigrams and bigrams are estimated: one of texts labelled good (the
target), one of all texts (the raw corpus).  A document's importance is the log of the ratio
of its probabilities under both, per n-gram.  Documents are drawn without replacement by
Gumbel top-k: to each importance, scaled by the spread of good documents, a Gumbel noise
that depends only on the document's id is added, and the k largest keys stay.

k is not a constant.  Labelled documents that neither model has seen give the importance
that separates good from bad, and k is the number of documents beyond it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Buckets of the hashed n-gram models.
BUCKETS = 1 << 15
#: Labelled documents that are used at most, for the target model and the cut together.
MAX_LABELLED = 20_000
#: N-grams of an average good text that are added to every text, so that a few words weigh little.
PRIOR_NGRAMS = 60
#: How much worse it is to reject a good document than to let a bad one in.
LOSS_WEIGHT = 4.0
#: Key bits told apart by one round of the search for the k-th largest key.
_DIGIT_BITS = 16

_UNITS = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and runs of signs of a text, and of their neighbouring pairs.

    A pair of equal units says "repeated" whatever the unit is, so all such pairs share a bucket.
    """
    units = _UNITS.findall(text.lower()) if text else []
    crc = zlib.crc32
    one = np.fromiter((crc(u.encode()) for u in units), np.uint32, len(units)).astype(np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    two[one[:-1] == one[1:]] = 0
    return np.concatenate((one, two)).astype(np.int64) % buckets


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of at most ``most`` labelled rows, drawn by a hash of the id.

    The driver holds two numbers for each; nothing else here depends on the bound.
    """
    rows = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).cast("bigint").alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
        .collect()
    )
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _parts(ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids whose good texts teach the target model, and ids (of either label) that place the cut."""
    # The sample comes in the order of its hash.
    teach = np.arange(len(ids)) % 4 != 3
    return np.sort(ids[teach & (labels == 1)]), np.sort(ids[~teach])


def _in(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.isin(ids, held) if len(held) else np.zeros(len(ids), bool)


def ngram_counts(docs: DataFrame, target_ids: np.ndarray, *, buckets: int, id_col: str, text_col: str) -> tuple:
    """Bucket counts of all texts and of the target's texts: one read, one short row per task and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for rows in slices(batches):
            ids = rows.column("_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for text, is_target in zip(rows.column("_text").to_pylist(), _in(ids, target_ids).tolist()):
                found = np.bincount(ngram_buckets(text, buckets), minlength=buckets)
                raw += found
                if is_target:
                    target += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw[used], "target": target[used]})

    rows = (
        _source(docs, id_col, text_col)
        .mapInArrow(count, "bucket bigint, raw bigint, target bigint")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
        .collect()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in rows:
        raw[bucket], target[bucket] = a, b
    return raw, target


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the ratio of both models per bucket, each smoothed by one count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def importances(
    docs: DataFrame, ratio: np.ndarray, *, usual: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, log_weight``: the mean log ratio over the n-grams of a text.

    ``PRIOR_NGRAMS`` n-grams of the ratio ``usual`` count along; a text without any has that weight.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found = [ratio[ngram_buckets(t, len(ratio))] for t in rows.column("_text").to_pylist()]
            means = [(float(x.sum()) + PRIOR_NGRAMS * usual) / (len(x) + PRIOR_NGRAMS) for x in found]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(means, pa.float64())], ["_id", "log_weight"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(score, f"_id {kind}, log_weight double").withColumnRenamed("_id", id_col)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The importance at which labelled documents are best told apart, in the middle of the gap.

    Both kinds of error count by their share, lost good documents ``LOSS_WEIGHT`` times.  With
    one label only nothing is rejected.
    """
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    let_in = 1 - np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    error = LOSS_WEIGHT * lost + let_in
    edges = np.concatenate(([-np.inf], (w[1:] + w[:-1]) / 2, [np.inf]))
    distinct = np.concatenate(([True], w[1:] > w[:-1], [True]))
    error[~distinct] = np.inf
    return float(edges[int(np.argmin(error))])


def gumbel(id_column: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and seed only."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def _ordered_bits(key: Column) -> Column:
    """A long that orders as the double does."""
    big = F.lit(float(1 << 40))
    return F.floor(F.greatest(F.least(key, F.lit(4e6)), F.lit(-4e6)) * big).cast("bigint") + F.lit(1 << 62)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of non-negative longs, None if there are no k of them.

    Four counts by 16 bits each, so at most 65,536 numbers reach the driver at a time and no
    task ever sorts the column.
    """
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in range(64 - _DIGIT_BITS, -1, -_DIGIT_BITS):
        digit = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        rows = keys if shift == 64 - _DIGIT_BITS else keys.filter(
            F.shiftrightunsigned(F.col(column), shift + _DIGIT_BITS) == F.lit(prefix)
        )
        for value, n in sorted(rows.groupBy(digit.alias("_d")).count().collect(), reverse=True):
            if n >= left:
                prefix = prefix << _DIGIT_BITS | value
                break
            left -= n
        else:
            return None
    return prefix


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    k: int | None = None,
    seed: int = 0,
    temperature: float = 0.02,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    buckets: int = BUCKETS,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """One row per document: ``id_col, log_weight, key, kept``.

    Labels are 1 (target) or 0.  At most ``max_labelled`` of them are used, drawn by hash:
    three quarters of the good ones make the target model, the rest of either label the cut.
    All documents make the raw model and all are scored.  ``key`` is the importance plus
    Gumbel noise times ``temperature`` times the distance of the cut from the mean good
    importance; temperature 1 or more draws freely, small values reject by importance.
    ``k`` documents are kept, ties at the last key with them; by default as many as lie
    beyond the cut.

    Null and empty texts weigh as much as the average good text.  Rows that repeat an
    id share one noise.  Without labels of both kinds all documents stay unless ``k`` is
    given; an empty table gives an empty table.
    """
    ids, marks = labelled_sample(labels, id_col, label_col, max_labelled)
    teach, hold = _parts(ids, marks)
    raw, target = ngram_counts(docs, teach, buckets=buckets, id_col=id_col, text_col=text_col)
    ratio = log_ratio(raw, target) if target.sum() else np.zeros(buckets)
    usual = float((ratio * target).sum() / max(1.0, target.sum()))
    scored = materialize(importances(docs, ratio, usual=usual, id_col=id_col, text_col=text_col), "importance")
    # The labelled rows of the cut are bounded by max_labelled; one row per id.
    known = dict(zip(ids.tolist(), marks.tolist()))
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(int(i),) for i in hold], "_held bigint")
    held = (
        scored.join(F.broadcast(wanted), F.col(id_col) == F.col("_held"))
        .groupBy("_held")
        .agg(F.first("log_weight"))
        .collect()
    )
    weights = np.array([r[1] for r in held], float)
    good = np.array([known[r[0]] == 1 for r in held], bool)
    cut = best_cut(weights, good)
    scale = abs(float(weights[good].mean()) - cut) if math.isfinite(cut) else 1.0
    noise = gumbel(F.col(id_col), seed) * F.lit(temperature * scale)
    keyed = scored.withColumn("key", F.col("log_weight") + noise).withColumn("_bits", _ordered_bits(F.col("key")))
    if k is None:
        k = scored.filter(F.col("log_weight") >= F.lit(cut)).count() if math.isfinite(cut) else scored.count()
    last = kth_largest(keyed, "_bits", k)
    if last is None:
        kept = F.lit(k > 0)
    else:
        kept = F.col("_bits") >= F.lit(last)
    return keyed.withColumn("kept", kept).drop("_bits")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns."""
    kept = resample(docs, labels, id_col=id_col, **options).filter("kept")
    kept = kept.select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
