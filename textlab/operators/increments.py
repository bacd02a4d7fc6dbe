"""Splits, ids and metrics of rows that arrive in batches, without reading earlier rows again.

Each keeps a small state that merges: counts per hash prefix, an offset log, score
histograms.  Batches have names; one that comes again, after a failure or by mistake, counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.functions.labels import UNKNOWN_SOURCE
from textlab.operators import metrics as M
from textlab.operators.ranks import PREFIX_DIGITS, cuts_of_keys, dense_ids, holding_prefixes, with_hash_key
from textlab.operators.splits import SEED, apply_cuts, cuts_from_counts
from textlab.storage import Batches, materialize


class GrowingSplit:
    """The stratified split of all rows so far.

    A batch leaves its counts per label and hash prefix, and its keys, sorted by prefix in each
    file.  The cuts of the union follow from the sum of the counts and the keys of the few
    prefixes in which a cut falls, for which the scan skips what cannot hold them.  They move as rows arrive; :meth:`cuts` gives those of now, and
    :meth:`assign` compares any table with them.
    """

    def __init__(self, spark: SparkSession, path: str, *, seed: int = SEED, digits: int = PREFIX_DIGITS):
        self.spark, self.seed, self.digits = spark, seed, digits
        self._store = Batches(spark, path, "n BIGINT")

    def add(self, rows: DataFrame, batch: str) -> None:
        """``id`` and ``label`` of rows; ids are unique over all batches.  Rows without a label have no split."""
        if self._store.holds(batch):
            return
        labelled = with_hash_key(rows.filter(F.col("label").isNotNull()).select("id", "label"), "id", self.seed)
        keys = labelled.select("label", "_key", F.substring("_key.h", 1, self.digits).alias("_prefix"))
        stored = self._store.write("keys", batch, keys.sortWithinPartitions("_prefix"))
        counts = stored.groupBy("label", "_prefix").agg(F.count("*").alias("_count"))
        counted = self._store.write("counts", batch, counts)
        self._store.commit(batch, counted.agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0])

    def cuts(self, **shares) -> DataFrame:
        """The split of all rows so far as a rule, as :func:`textlab.operators.splits.split_cuts` gives it."""
        counts = self._store.read("counts", "label STRING, _prefix STRING, _count BIGINT")
        counts = materialize(counts.groupBy("label", "_prefix").agg(F.sum("_count").alias("_count")), "counts")
        keys = self._store.read("keys", "label STRING, _key STRUCT<h: STRING, id: STRING>, _prefix STRING")

        def find(targets: DataFrame) -> DataFrame:
            # A row per cut.
            holding = materialize(holding_prefixes(counts, targets, ["label"]), "holding")
            prefixes = sorted({r["_prefix"] for r in holding.collect()})
            return cuts_of_keys(keys.filter(F.col("_prefix").isin(prefixes)), holding, ["label"])

        return cuts_from_counts(self.spark, counts, find, **shares)

    def assign(self, rows: DataFrame, **shares) -> DataFrame:
        """Any table with ``id`` and ``label``, with the ``split`` of now."""
        return apply_cuts(rows, self.cuts(**shares), seed=self.seed)


class GrowingIds:
    """Dense ids 0, 1, 2, ... over all batches: a batch goes on where the one before ended.

    Within a batch ids follow ``order_by``, or without it the order in which its rows are read.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "id"):
        self.id_col = id_col
        self._store = Batches(spark, path, "start BIGINT, n BIGINT")

    def add(self, rows: DataFrame, batch: str, order_by: Sequence[str | Column] | None = None) -> None:
        log = self._store.log()
        if any(line["batch"] == batch for line in log):
            return
        start = max((line["start"] + line["n"] for line in log), default=0)
        numbered = dense_ids(rows, order_by, self.id_col)
        written = self._store.write("rows", batch, numbered.withColumn(self.id_col, F.col(self.id_col) + F.lit(start)))
        self._store.commit(batch, start, written.count())

    def rows(self, schema, batches: Sequence[str] | None = None) -> DataFrame:
        """The numbered rows; ``schema`` is that of a batch with its id."""
        return self._store.read("rows", schema, batches)


class GrowingMetrics:
    """Metrics of all predictions so far, overall and by source, from stored score histograms.

    A batch leaves, per source and distinct score, how many rows of either class it has.
    Histograms add up, so the metrics of any batches follow without their predictions.
    """

    _HISTOGRAM = "_source STRING, score DOUBLE, pos BIGINT, neg BIGINT, tp BIGINT, fp BIGINT"

    def __init__(self, spark: SparkSession, path: str, *, source: str = "source_model"):
        self.source = source
        self._store = Batches(spark, path, "n BIGINT")

    def add(self, predictions: DataFrame, batch: str) -> None:
        """``label, prediction, confidence`` and the source column of some rows."""
        if self._store.holds(batch):
            return
        named = predictions.withColumn("_source", F.coalesce(F.col(self.source), F.lit(UNKNOWN_SOURCE)))
        stored = self._store.write("histogram", batch, M.score_histogram(named, ["_source"]))
        self._store.commit(batch, stored.agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0))).first()[0])

    def histogram(self, batches: Sequence[str] | None = None) -> DataFrame:
        found = self._store.read("histogram", self._HISTOGRAM, batches)
        counts = [F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")]
        return found.groupBy("_source", "score").agg(*counts)

    def overall(self, batches: Sequence[str] | None = None, **options) -> DataFrame:
        """What :func:`textlab.operators.metrics.metrics` gives for the predictions of some batches, or all."""
        merged = self.histogram(batches).groupBy("score").agg(
            *[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")]
        )
        return M.metrics_of_histogram(merged, **options)

    def by_source(self, batches: Sequence[str] | None = None, **options) -> DataFrame:
        """What :func:`textlab.operators.metrics.metrics_by_source` gives for them."""
        return M.source_metrics_of_histogram(self.histogram(batches), **options)
