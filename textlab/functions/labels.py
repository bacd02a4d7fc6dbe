"""Label alignment and defaults for the normalized schema."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textlab.functions.text import na_to_null, strip

AI = "ai"
HUMAN = "human"

# Raw labels that mean "ai" and "human", after lower-casing and stripping.
AI_WORDS = ("ai", "generated", "machine", "1", "true", "yes")
HUMAN_WORDS = ("human", "original", "real", "0", "false", "no")
# The adversarial source accepts fewer words for "human".
HUMAN_WORDS_ADVERSARIAL = ("human", "0", "false", "no")

# Defaults for missing provenance.
UNKNOWN_MODEL = "unknown_ai"
UNKNOWN_PLATFORM = "unknown"
UNKNOWN_SOURCE = "unknown"


def raw_label(c: Column) -> Column:
    """A raw label in comparable form; null stays null."""
    return strip(F.lower(na_to_null(c)))


def map_label(raw: Column, human_words=HUMAN_WORDS) -> Column:
    """``ai``, ``human`` or null for a label outside both word lists."""
    return F.when(raw.isin(*AI_WORDS), AI).when(raw.isin(*human_words), HUMAN)


def source_model(model: Column, label: Column) -> Column:
    default = F.when(label == HUMAN, HUMAN).otherwise(UNKNOWN_MODEL)
    return F.coalesce(strip(na_to_null(model)), default)


def platform(c: Column) -> Column:
    return F.coalesce(F.lower(strip(na_to_null(c))), F.lit(UNKNOWN_PLATFORM))


def is_ai(label: Column) -> Column:
    """1 for ``ai``, 0 for everything else."""
    return F.coalesce((label == AI).cast("int"), F.lit(0))
