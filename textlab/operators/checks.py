"""Data-quality checks.  Each returns a one-row DataFrame with an ``ok`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.vectors import l2_normalize

# Fixed value: the similarity that the self-match check asks for.
SELF_MATCH_SCORE = 0.99
# Directions that agree to so many digits are the same.
DIRECTION_DIGITS = 12


def check_alignment(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys on either side only, keys on both, and keys that occur twice.

    Both sides are reduced per key before they meet, so a repeated key costs nothing.
    """
    tagged = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    keys = tagged.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))

    def count(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    l, r = F.col("_l"), F.col("_r")
    counts = keys.agg(
        count((l > 0) & (r > 0)).alias("n_both"),
        count(r == 0).alias("n_left_only"),
        count(l == 0).alias("n_right_only"),
        count((l > 1) | (r > 1)).alias("n_repeated"),
    )
    bad = F.col("n_left_only") + F.col("n_right_only") + F.col("n_repeated")
    return counts.withColumn("ok", bad == 0)


def check_predictions(records: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Whether every record has exactly one prediction, and no prediction is left over."""
    found = check_alignment(records, predictions, key)
    return found.select(
        (F.col("n_both") + F.col("n_left_only")).alias("n_records"),
        F.col("n_left_only").alias("n_missing"),
        F.col("n_right_only").alias("n_unexpected"),
        F.col("n_repeated").alias("n_repeated"),
        "ok",
    )


def check_self_match(
    train: DataFrame, *, min_score: float = SELF_MATCH_SCORE, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Share of candidate rows whose nearest neighbour is the row itself.

    A vector is most similar to itself, with a score of 1, unless it has no direction.  What can
    stand before it is a copy with a smaller id, so of each group of rows with one direction
    exactly one matches itself: no row has to be searched, and groups of any size are
    counted before they meet.
    """
    # Whole numbers, so that 0.0 and -0.0 are one; a row without a direction is in no group.
    scale = 10.0**DIRECTION_DIGITS
    listed = F.transform(l2_normalize(F.col(vector)), lambda x: F.round(x * scale).cast("bigint").cast("string"))
    direction = F.when(F.exists(vector, lambda x: x != 0), F.unhex(F.sha2(F.array_join(listed, ","), 256)))
    groups = train.select(key, direction.alias("_direction")).groupBy("_direction").agg(F.count("*").alias("_n"))
    matches = F.col("_direction").isNotNull() & F.lit(min_score < 1.0)
    hits = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(matches.cast("bigint")), F.lit(0)).alias("n_self"),
    )
    return hits.select(
        "n_rows",
        "n_self",
        (F.col("n_self") / F.when(F.col("n_rows") > 0, F.col("n_rows"))).alias("share"),
        (F.col("n_self") == F.col("n_rows")).alias("ok"),
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The input itself, or an error when it has no rows.  Meant for the edges of a job."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df
