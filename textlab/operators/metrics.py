"""Accuracy, macro-F1, AUROC and TPR at a fixed FPR, for any number of groups at once.

Predictions are first reduced to a histogram: per group and distinct score, how many rows
of either class.  The histogram is stored, so the predictions are read once; everything
after that works on it.  Its cumulative sums are plain windows while it is small.  A large
one -- a predictor that returns a different double for every row -- is summed in two levels,
inside slabs of neighbouring scores and over the slab totals, with slab borders at the
quantiles of the distinct scores, so that scores crowded into a narrow range still spread
evenly over the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.labels import UNKNOWN_SOURCE, is_ai
from textlab.storage import materialize

# The false-positive rate reported, and printed digits.
FPR = 0.01
DIGITS = 4

# A histogram up to this many rows is summed in one level; beyond, there is a slab for each
# so many rows, within these bounds.
SMALL = 1_000_000
LEAST_SLABS, MOST_SLABS = 256, 10_000

_COUNTS = ("pos", "neg", "tp", "fp")


def score_histogram(predictions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, score, pos, neg, tp, fp`` from ``label, prediction, confidence``.

    A prediction without a confidence has no place among the scores and is an error.
    """
    truth = is_ai(F.col("label")).cast("bigint")
    said = is_ai(F.col("prediction")).cast("bigint")
    missing = F.raise_error(F.lit("a prediction has no confidence")).cast("double")
    score = F.coalesce(F.col("confidence").cast("double"), missing)
    rows = predictions.select(
        *groups, score.alias("score"), truth.alias("_y"), said.alias("_p")
    )
    return rows.groupBy(*groups, "score").agg(
        F.sum("_y").alias("pos"),
        F.sum(1 - F.col("_y")).alias("neg"),
        F.sum(F.col("_y") * F.col("_p")).alias("tp"),
        F.sum((1 - F.col("_y")) * F.col("_p")).alias("fp"),
    )


def _cumulative(histogram: DataFrame, groups: Sequence[str], small: int) -> DataFrame:
    """Add ``cum_pos, cum_neg`` (rows at this score or higher) and ``n_pos, n_neg`` per group."""
    groups = list(groups)
    whole = Window.partitionBy(*groups)
    rows = histogram.count()
    if rows <= small:
        down = whole.orderBy(F.desc("score"))
        return histogram.select(
            "*",
            F.sum("pos").over(down).alias("cum_pos"),
            F.sum("neg").over(down).alias("cum_neg"),
            F.sum("pos").over(whole).alias("n_pos"),
            F.sum("neg").over(whole).alias("n_neg"),
        )
    slabs = min(MOST_SLABS, max(LEAST_SLABS, rows // SMALL))
    steps = [i / slabs for i in range(1, slabs)]
    borders = histogram.agg(F.percentile_approx("score", steps, 10 * slabs)).first()[0]
    slab = F.size(F.filter(F.lit(borders), lambda border: border < F.col("score")))
    slabbed = histogram.withColumn("_slab", slab)
    # A row per slab and group.
    totals = slabbed.groupBy(*groups, "_slab").agg(F.sum("pos").alias("_sp"), F.sum("neg").alias("_sn"))
    above = whole.orderBy(F.desc("_slab"))
    offsets = totals.select(
        *groups,
        "_slab",
        (F.sum("_sp").over(above) - F.col("_sp")).alias("_op"),
        (F.sum("_sn").over(above) - F.col("_sn")).alias("_on"),
        F.sum("_sp").over(whole).alias("n_pos"),
        F.sum("_sn").over(whole).alias("n_neg"),
    )
    inside = Window.partitionBy(*groups, "_slab").orderBy(F.desc("score"))
    # A null group is a group like any other.
    keys = [*groups, "_slab"]
    offsets = offsets.withColumnsRenamed({c: f"_o_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys]
    return (
        slabbed.withColumn("_ip", F.sum("pos").over(inside))
        .withColumn("_in", F.sum("neg").over(inside))
        .join(offsets, same)
        .drop(*[f"_o_{c}" for c in keys])
        .withColumn("cum_pos", F.col("_op") + F.col("_ip"))
        .withColumn("cum_neg", F.col("_on") + F.col("_in"))
        .drop("_slab", "_ip", "_in", "_op", "_on")
    )


def roc_curve(predictions: DataFrame, groups: Sequence[str] = (), *, small: int = SMALL) -> DataFrame:
    """``*groups, threshold, fpr, tpr``: one point per distinct score, and the start at (0, 0).

    The starting point lies above every score and has a null threshold.
    """
    points = _cumulative(materialize(score_histogram(predictions, groups), "scores"), groups, small)
    rate = lambda part, whole: F.when(whole > 0, part / whole)
    curve = points.select(
        *groups,
        F.col("score").alias("threshold"),
        rate(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
        rate(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
    )
    first = points.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") > 0)
    start = first.select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def _f1(hits: Column, misses: Column) -> Column:
    whole = 2 * hits + misses
    return F.when(whole > 0, 2 * hits / whole).otherwise(F.lit(0.0))


def _summarize(
    histogram: DataFrame, groups: Sequence[str], fpr: float, digits: int | None, small: int
) -> DataFrame:
    points = _cumulative(histogram, groups, small)
    rate = F.col("cum_neg") / F.when(F.col("n_neg") > 0, F.col("n_neg"))
    # Pairs of one row of either class that the score puts in the right order; ties count half.
    ordered = F.col("pos") * (F.col("n_neg") - F.col("cum_neg") + 0.5 * F.col("neg"))
    sums = points.groupBy(*groups).agg(
        *[F.sum(c).alias(f"_{c}") for c in _COUNTS],
        F.sum(ordered).alias("_ordered"),
        # Both counts only grow along the curve: the last point within the rate has the largest
        # ones, the first point beyond it the smallest.
        F.max(F.when(rate <= fpr, F.col("cum_neg"))).alias("_left_neg"),
        F.max(F.when(rate <= fpr, F.col("cum_pos"))).alias("_left_pos"),
        F.min(F.when(rate > fpr, F.col("cum_neg"))).alias("_right_neg"),
        F.min(F.when(rate > fpr, F.col("cum_pos"))).alias("_right_pos"),
    )
    pos, neg, tp, fp = (F.col(f"_{c}") for c in _COUNTS)
    fn, tn = pos - tp, neg - fp
    both = (pos > 0) & (neg > 0)
    x0 = F.coalesce(F.col("_left_neg"), F.lit(0)) / neg
    y0 = F.coalesce(F.col("_left_pos"), F.lit(0)) / pos
    x1, y1 = F.col("_right_neg") / neg, F.col("_right_pos") / pos
    interpolated = F.coalesce(y0 + (F.lit(float(fpr)) - x0) * (y1 - y0) / (x1 - x0), y0)
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return sums.select(
        *groups,
        (pos + neg).alias("n_records"),
        pos.alias("n_ai"),
        neg.alias("n_human"),
        shown((tp + tn) / (pos + neg)).alias("accuracy"),
        F.when(both, shown((_f1(tp, fp + fn) + _f1(tn, fn + fp)) / 2)).alias("macro_f1"),
        F.when(both, shown(F.col("_ordered") / (pos.cast("double") * neg))).alias("auroc"),
        F.when(both, shown(interpolated)).alias("tpr_at_1fpr"),
    )


def metrics(
    predictions: DataFrame,
    groups: Sequence[str] = (),
    *,
    fpr: float = FPR,
    digits: int | None = DIGITS,
    small: int = SMALL,
) -> DataFrame:
    """One row of metrics per group.

    With one class only, accuracy is kept and the other three are null.
    """
    return metrics_of_histogram(score_histogram(predictions, groups), groups, fpr=fpr, digits=digits, small=small)


def metrics_of_histogram(
    histogram: DataFrame,
    groups: Sequence[str] = (),
    *,
    fpr: float = FPR,
    digits: int | None = DIGITS,
    small: int = SMALL,
) -> DataFrame:
    """:func:`metrics` from ``*groups, score, pos, neg, tp, fp``."""
    return _summarize(materialize(histogram, "scores"), list(groups), fpr, digits, small)


def metrics_by_source(
    predictions: DataFrame,
    source: str = "source_model",
    *,
    fpr: float = FPR,
    digits: int | None = DIGITS,
    small: int = SMALL,
) -> DataFrame:
    """Overall metrics (null ``source_model``) and one row per source, from one pass.

    The rows are reduced per source first; the overall histogram comes from that, not
    from a second copy of the rows.
    """
    named = predictions.withColumn("_source", F.coalesce(F.col(source), F.lit(UNKNOWN_SOURCE)))
    return source_metrics_of_histogram(score_histogram(named, ["_source"]), fpr=fpr, digits=digits, small=small)


def source_metrics_of_histogram(
    fine: DataFrame, *, fpr: float = FPR, digits: int | None = DIGITS, small: int = SMALL
) -> DataFrame:
    """:func:`metrics_by_source` from ``_source, score, pos, neg, tp, fp``."""
    both = (
        fine.groupingSets([["score"], ["_source", "score"]], "_source", "score")
        .agg(
            F.grouping("_source").cast("int").alias("_overall"),
            *[F.sum(c).alias(c) for c in _COUNTS],
        )
        .withColumn("_source", F.coalesce(F.col("_source"), F.lit("")))
    )
    result = _summarize(materialize(both, "scores"), ["_overall", "_source"], fpr, digits, small)
    return result.select(
        F.when(F.col("_overall") == 0, F.col("_source")).alias("source_model"), *result.columns[2:]
    )


def metrics_by_split(predictions: DataFrame, k: int, **options) -> DataFrame:
    """Metrics per split with the neighbour count they belong to."""
    rows = metrics(predictions, ["split"], **options)
    return rows.select("split", F.lit(k).alias("k"), *[c for c in rows.columns if c != "split"])


def printable(results: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Metrics as text, ``N/A`` where undefined, sorted with the overall row first."""
    names = ("accuracy", "macro_f1", "auroc", "tpr_at_1fpr")
    shown = [F.coalesce(F.format_number(c, digits), F.lit("N/A")).alias(c) for c in names]
    return results.select(*[c for c in results.columns if c not in names], *shown).orderBy(
        *[c for c in results.columns if c in ("source_model", "split")]
    )
