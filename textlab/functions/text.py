"""Text expressions.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points that count as whitespace -- Unicode's White_Space property
# and the four separators U+001C..U+001F -- as the body of a regex character class.
WHITESPACE = r"\s\x1c-\x1f"
UNICODE = "(?U)"

# URL pattern (case-sensitive) and its replacement.
URL_PATTERN = rf"{UNICODE}https?://[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+"
URL_TOKEN = "[URL]"

# Whitespace that has to change: anything but a single plain space.
_UNEVEN = rf"{UNICODE}[{WHITESPACE}&&[^ ]][{WHITESPACE}]*| [{WHITESPACE}]+"

# Strings that delimited files use for "no value".
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(c, rf"{UNICODE}^[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def clean_text(c: Column) -> Column:
    """URLs become ``[URL]``, whitespace runs become one space, ends are trimmed; null gives ''."""
    may_have_url = c.contains("http") | c.contains("www.")
    without_urls = F.when(may_have_url, F.regexp_replace(c, URL_PATTERN, URL_TOKEN)).otherwise(c)
    return F.coalesce(F.trim(F.regexp_replace(without_urls, _UNEVEN, " ")), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of words in text that :func:`clean_text` has already normalized."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def has_words(c: Column, n: int) -> Column:
    """Whether a text has at least ``n`` words, decided without reading past the n-th.

    Works on raw text too: cleaning neither joins nor splits words, so a filter on the raw
    column can run in the scan, before anything is cleaned.
    """
    if n <= 0:
        return F.lit(True)
    words = rf"(?:[^{WHITESPACE}]++[{WHITESPACE}]++){{{n - 1}}}[^{WHITESPACE}]"
    return F.coalesce(c.rlike(rf"{UNICODE}^[{WHITESPACE}]*+{words}"), F.lit(False))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_STRINGS), c)


def truncate(c: Column, limit: int = 300) -> Column:
    """The first ``limit`` code points, with ``...`` only where something was cut."""
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))
    ).otherwise(c)


def seeded_hash(key: Column, seed: int) -> Column:
    """A hash of the row's key that depends on nothing but the key and the seed."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def hash_uniform(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of ``digest`` from position ``start`` as a number in [0, 1)."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)
