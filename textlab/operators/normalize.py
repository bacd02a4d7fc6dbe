"""Raw tables with differing headers -> one labelled corpus schema."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from textlab.functions import labels as L
from textlab.functions.text import clean_text, has_words, na_to_null, strip

MIN_WORDS = 5

# Accepted header names per field, compared without case.
SOCIAL_HEADERS = {
    "text": ("text", "content", "post", "message"),
    "label": ("label", "class", "is_ai", "generated"),
    "model": ("model", "source_model", "generator", "source"),
    "platform": ("platform", "social_media", "network", "source_platform"),
}
ADVERSARIAL_HEADERS = {
    "text": ("text", "generation", "content", "output"),
    "model": ("model", "source_model", "generator"),
    "label": ("label", "class", "is_ai"),
}

# Names of the three kinds of source and the constants of the last two.
SOCIAL_DATASET = "multisocial"
ANSWERS_DATASET = "hc3"
ANSWERS_PLATFORM = "qa_forum"
ANSWERS_MODEL = "chatgpt"
ADVERSARIAL_DATASET = "raid"
ADVERSARIAL_PLATFORM = "raid"

CORPUS_FIELDS = ("text", "label", "source_model", "platform", "dataset")
ALIGNED_SCHEMA = (
    "text STRING, raw_label STRING, label STRING, source_model STRING, platform STRING, dataset STRING"
)


def discover_columns(
    columns: Sequence[str], headers: Mapping[str, Sequence[str]]
) -> dict[str, str | None]:
    """Field -> the first column, in header order, whose name is accepted for it."""
    return {
        field: next((c for c in columns if c.lower() in names), None)
        for field, names in headers.items()
    }


def _column(name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("string")
    return F.col(f"`{name}`").cast("string")


def _no_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    warnings.warn(f"skipped a table without a text column; it has {', '.join(df.columns)}", stacklevel=3)
    fields = [f.split() for f in ALIGNED_SCHEMA.split(", ")]
    empty = [F.lit(None).cast(kind.lower()).alias(name) for name, kind in fields]
    return df.filter(F.lit(False)).select(*empty, *keep)


def long_enough(df: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Rows whose text, raw or cleaned, has at least ``min_words`` words."""
    return df.filter(has_words(F.col(f"`{text}`"), min_words))


def align_social(
    df: DataFrame,
    *,
    dataset: str = SOCIAL_DATASET,
    headers: Mapping[str, Sequence[str]] = SOCIAL_HEADERS,
    min_words: int = MIN_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Map a raw social table; rows with an unrecognized label keep a null ``label``.

    A table without a text column gives no rows.  Without a label column every row
    is human.  Short rows go first, so they never reach the unknown-label tally.
    """
    found = discover_columns([c for c in df.columns if c not in keep], headers)
    if found["text"] is None:
        return _no_rows(df, keep)
    # A missing label in a table that has a label column is an unknown label, spelled "nan".
    raw = F.coalesce(L.raw_label(_column(found["label"])), F.lit("nan"))
    label = L.map_label(raw) if found["label"] else F.lit(L.HUMAN)
    rows = long_enough(df, min_words, found["text"]).select(
        clean_text(_column(found["text"])).alias("text"),
        (raw if found["label"] else F.lit(None).cast("string")).alias("raw_label"),
        label.alias("label"),
        _column(found["model"]).alias("_model"),
        L.platform(_column(found["platform"])).alias("platform"),
        *keep,
    )
    return rows.select(
        "text",
        "raw_label",
        "label",
        L.source_model(F.col("_model"), F.col("label")).alias("source_model"),
        "platform",
        F.lit(dataset).alias("dataset"),
        *keep,
    )


def align_adversarial(
    df: DataFrame,
    *,
    dataset: str = ADVERSARIAL_DATASET,
    platform: str = ADVERSARIAL_PLATFORM,
    headers: Mapping[str, Sequence[str]] = ADVERSARIAL_HEADERS,
    min_words: int = MIN_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Map the adversarial table: a missing label falls back to "has a model name -> ai"."""
    found = discover_columns([c for c in df.columns if c not in keep], headers)
    if found["text"] is None:
        return _no_rows(df, keep)
    rows = long_enough(df, min_words, found["text"]).select(
        clean_text(_column(found["text"])).alias("text"),
        L.raw_label(_column(found["label"])).alias("raw_label"),
        _column(found["model"]).alias("_model"),
        *keep,
    )
    has_model = strip(na_to_null(F.col("_model"))) != ""
    label = (
        F.when(F.col("raw_label").isNotNull(), L.map_label(F.col("raw_label"), L.HUMAN_WORDS_ADVERSARIAL))
        .when(has_model, L.AI)
        .otherwise(L.HUMAN)
    )
    return rows.withColumn("label", label).select(
        "text",
        "raw_label",
        "label",
        L.source_model(F.col("_model"), F.col("label")).alias("source_model"),
        F.lit(platform).alias("platform"),
        F.lit(dataset).alias("dataset"),
        *keep,
    )


def explode_answers(
    df: DataFrame,
    *,
    human: str = "human_answers",
    machine: str = "chatgpt_answers",
    machine_model: str = ANSWERS_MODEL,
    platform: str = ANSWERS_PLATFORM,
    dataset: str = ANSWERS_DATASET,
    min_words: int = MIN_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per answer: first the human answers of a record, then the machine ones.

    Both arrays go through a single ``explode``, so the input is read once.  A null or
    empty array gives no rows.  ``answer_pos`` is the place within the record and
    completes a unique sort key.
    """

    def tagged(array: str, label: str, model: str) -> Column:
        answers = F.coalesce(F.col(array), F.array().cast("array<string>"))
        return F.transform(
            answers,
            lambda a: F.struct(a.alias("answer"), F.lit(label).alias("label"), F.lit(model).alias("source_model")),
        )

    answers = F.concat(tagged(human, L.HUMAN, L.HUMAN), tagged(machine, L.AI, machine_model))
    rows = df.select(*keep, F.posexplode(answers).alias("answer_pos", "a")).filter(
        has_words(F.col("a.answer"), min_words)
    )
    return rows.select(
        clean_text(F.col("a.answer")).alias("text"),
        F.col("a.label").alias("label"),
        F.col("a.source_model").alias("source_model"),
        F.lit(platform).alias("platform"),
        F.lit(dataset).alias("dataset"),
        *keep,
        "answer_pos",
    )


def accepted(aligned: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a recognized label, in the corpus schema."""
    return aligned.filter(F.col("label").isNotNull()).select(*CORPUS_FIELDS, *keep)


class Tallies:
    """How many rows of each source were read, too short, unknown or accepted, counted while they are written.

    ``align`` gives the accepted rows of a source.  When whatever writes them has run, once,
    ``report`` has the counts; the sources are not read again.  A source without a text column
    counts as read with everything skipped.
    """

    def __init__(self):
        self._seen: dict[str, tuple[Observation, Observation]] = {}

    def align(
        self,
        name: str,
        df: DataFrame,
        align: Callable[..., DataFrame] = align_social,
        *,
        headers: Mapping[str, Sequence[str]] = SOCIAL_HEADERS,
        min_words: int = MIN_WORDS,
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """The accepted rows of a source, which count under ``name``."""
        text = discover_columns([c for c in df.columns if c not in keep], headers)["text"]
        short = ~has_words(F.col(f"`{text}`"), min_words) if text else F.lit(True)
        read, kept = self._seen[name] = Observation(), Observation()
        seen = df.observe(read, F.count("*").alias("n_read"), F.count_if(short).alias("n_short"))
        if text is None:
            # Nothing is kept, but the rows go by, so that they are counted.
            aligned = seen.select(
                *[F.lit(None).cast(kind.lower()).alias(c) for c, kind in (f.split() for f in ALIGNED_SCHEMA.split(", "))], *keep
            )
            aligned = aligned.withColumn("raw_label", F.lit(None).cast("string"))
        else:
            aligned = align(seen, headers=headers, min_words=min_words, keep=keep)
        known = F.col("label").isNotNull()
        long = F.lit(text is not None)
        aligned = aligned.observe(
            kept, F.count_if(~known & long).alias("n_unknown"), F.count_if(known).alias("n_accepted")
        )
        return accepted(aligned, keep)

    def report(self, spark: SparkSession) -> DataFrame:
        """``source, n_read, n_short, n_unknown, n_accepted``; waits for the rows to be written."""
        names = ("n_read", "n_short", "n_unknown", "n_accepted")
        rows = []
        for source, (read, kept) in self._seen.items():
            counts = {**read.get, **kept.get}
            rows.append((source, *[counts[n] for n in names]))
        return spark.createDataFrame(rows, "source STRING, " + ", ".join(f"{n} BIGINT" for n in names))


def unknown_label_tally(aligned: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` most frequent unrecognized labels, with the total over all of them."""
    counts = aligned.filter(F.col("label").isNull()).groupBy("raw_label").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    return (
        counts.orderBy(F.desc("n"), "raw_label")
        .limit(top)
        .withColumn("n_total", total.scalar())
    )


def combine(*sources: DataFrame) -> DataFrame:
    """Bag union of normalized sources; duplicates stay."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other)
    return first
