"""Stratified splits and evaluation scenarios."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.functions.text import has_words
from textlab.operators.ranks import PREFIX_DIGITS, hash_cuts, prefix_counts, with_hash_key, within

# Split names, shares and seed.
TRAIN, VAL, TEST = "train", "val", "test"
HELD_OUT_SHARE = 0.30
TEST_SHARE_OF_HELD_OUT = 0.50
SEED = 42

# Held-out generator and platform, and the short-text limit.
HOLDOUT_MODEL = "chatgpt"
HOLDOUT_PLATFORM = "qa_forum"
SHORT_TEXT_WORDS = 100

# Scenario names; the two hold-outs are followed by the held-out value.
STANDARD, SHORT_TEXT, ADVERSARIAL = "standard", "short_text", "adversarial_raid"
CROSS_MODEL, CROSS_PLATFORM = "cross_model_", "cross_platform_"


def _largest_remainder(sizes: Mapping[str, int], draw: int) -> dict[str, int]:
    """Share ``draw`` units in proportion to ``sizes``.

    Whole-number arithmetic; left-over units go to the largest remainders, ties to the
    label that sorts first.
    """
    total = sum(sizes.values())
    if total == 0:
        return dict.fromkeys(sizes, 0)
    shares = {label: n * draw // total for label, n in sizes.items()}
    spare = draw - sum(shares.values())
    by_remainder = sorted(sizes, key=lambda label: (-(sizes[label] * draw % total), label))
    for label in by_remainder[:spare]:
        shares[label] += 1
    return shares


def split_quotas(
    sizes: Mapping[str, int],
    held_out: float = HELD_OUT_SHARE,
    test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
) -> dict[str, tuple[int, int, int]]:
    """Exact number of train, val and test rows per label."""
    total = sum(sizes.values())
    n_held = math.ceil(held_out * total)
    n_test = math.ceil(test_of_held_out * n_held)
    train = _largest_remainder(sizes, total - n_held)
    rest = {label: n - train[label] for label, n in sizes.items()}
    val = _largest_remainder(rest, n_held - n_test)
    return {label: (train[label], val[label], rest[label] - val[label]) for label in sizes}


def split_cuts(
    corpus: DataFrame,
    *,
    held_out: float = HELD_OUT_SHARE,
    test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
    seed: int = SEED,
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """The whole split as a rule: one row per label with the last key of train and of val.

    Runs now.  Reads the id and label columns twice (counts per prefix, cut keys) and
    shuffles counts only; give it a stored columnar table.
    """
    spark = corpus.sparkSession
    labelled = corpus.filter(F.col("label").isNotNull())
    how = {"strata": ["label"], "seed": seed, "digits": digits}
    counts = prefix_counts(labelled, **how)
    return cuts_from_counts(
        spark, counts, lambda targets: hash_cuts(labelled, counts, targets, **how), held_out, test_of_held_out
    )


def cuts_from_counts(
    spark: SparkSession,
    counts: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    held_out: float = HELD_OUT_SHARE,
    test_of_held_out: float = TEST_SHARE_OF_HELD_OUT,
) -> DataFrame:
    """The rule of :func:`split_cuts` from counts per label and prefix; ``find`` looks the wanted keys up."""
    # One row per label.
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("_count").alias("n")).collect()}
    quotas = split_quotas(sizes, held_out, test_of_held_out)
    targets = spark.createDataFrame(
        [
            row
            for label, (train, val, _) in quotas.items()
            for row in ((label, TRAIN, train), (label, VAL, train + val))
        ],
        "label STRING, name STRING, n BIGINT",
    )
    found = find(targets)
    cuts = {(r["label"], r["name"]): r["cut"] for r in found.collect()}
    key = found.schema["cut"].dataType.simpleString()
    return spark.createDataFrame(
        [(label, cuts.get((label, TRAIN)), cuts.get((label, VAL))) for label in quotas],
        f"label STRING, train_cut {key}, val_cut {key}",
    )


def apply_cuts(df: DataFrame, cuts: DataFrame, *, seed: int = SEED) -> DataFrame:
    """Add ``split`` to any table with ``id`` and ``label`` by comparing each row with the cuts.

    A map over the rows where they lie, whatever else they carry: no join on ids.  Rows with
    a label that the cuts do not know keep a null ``split``.
    """
    split = (
        F.when(within(F.col("_key"), F.col("train_cut")), TRAIN)
        .when(within(F.col("_key"), F.col("val_cut")), VAL)
        .when(F.col("_known"), TEST)
    )
    # One row per label.
    rule = F.broadcast(cuts.withColumn("_known", F.lit(True)))
    keyed = with_hash_key(df, "id", seed).join(rule, "label", "left")
    return keyed.select(*df.columns, split.alias("split"))


def assign_split(corpus: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The corpus with a ``split`` column: train, val or test with exact per-label quotas.

    Depends on ids, labels and seed only, not on how the input is partitioned.
    """
    return apply_cuts(corpus, split_cuts(corpus.select("id", "label"), seed=seed, **options), seed=seed)


def stratified_split(corpus: DataFrame, **options) -> DataFrame:
    """The split as a table of its own: ``id, split``."""
    return assign_split(corpus.select("id", "label"), **options).select("id", "split")


def with_split(df: DataFrame, splits: DataFrame, id_col: str = "id") -> DataFrame:
    """Look up each row's split in a stored table; rows without one keep a null ``split``.

    Splits made here need no look-up: :func:`apply_cuts` decides them row by row.
    """
    return df.join(splits.select(F.col("id").alias(id_col), "split"), id_col, "left")


def in_split(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col("split").isin(*names))


def holdout_test(corpus: DataFrame, column: str, value: str) -> DataFrame:
    """Every row of the held-out value, whatever split it was in."""
    return corpus.filter(F.col(column) == value).select("id")


def holdout_splits(corpus_with_split: DataFrame, column: str, value: str) -> DataFrame:
    """The other rows keep their train or val place; test rows are left out."""
    kept = ~F.coalesce(F.col(column) == value, F.lit(False))
    return in_split(corpus_with_split.filter(kept), TRAIN, VAL).select("id", "split")


def scenarios(
    corpus_with_split: DataFrame,
    adversarial: DataFrame | None = None,
    *,
    model: str = HOLDOUT_MODEL,
    platform: str = HOLDOUT_PLATFORM,
    short_words: int = SHORT_TEXT_WORDS,
) -> DataFrame:
    """The five evaluation sets as ``scenario, id, label``.

    The corpus is read once: each row lists the scenarios it belongs to.  Adversarial ids
    are in a number range of their own and never mix with corpus ids.
    """
    is_test = F.col("split") == TEST
    short = ~has_words(F.col("text"), short_words)
    member = F.array(
        F.when(is_test, F.lit(STANDARD)),
        F.when(F.col("source_model") == model, F.lit(CROSS_MODEL + model)),
        F.when(F.col("platform") == platform, F.lit(CROSS_PLATFORM + platform)),
        F.when(is_test & short, F.lit(SHORT_TEXT)),
    )
    rows = corpus_with_split.select(F.explode(F.array_compact(member)).alias("scenario"), "id", "label")
    if adversarial is None:
        return rows
    return rows.unionByName(adversarial.select(F.lit(ADVERSARIAL).alias("scenario"), "id", "label"))


def reduced_splits(
    corpus_with_split: DataFrame, *, model: str = HOLDOUT_MODEL, platform: str = HOLDOUT_PLATFORM
) -> DataFrame:
    """Train/val maps of both hold-out scenarios from one read: ``scenario, id, split``."""

    def kept(column: str, value: str) -> Column:
        return ~F.coalesce(F.col(column) == value, F.lit(False))

    member = F.array(
        F.when(kept("source_model", model), F.lit(CROSS_MODEL + model)),
        F.when(kept("platform", platform), F.lit(CROSS_PLATFORM + platform)),
    )
    rows = in_split(corpus_with_split, TRAIN, VAL)
    return rows.select(F.explode(F.array_compact(member)).alias("scenario"), "id", "split")
