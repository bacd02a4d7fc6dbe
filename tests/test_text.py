import random
import re

import pytest
from pyspark.sql import functions as F

from textlab.functions import labels as L
from textlab.functions.text import (
    clean_text,
    has_words,
    hash_uniform,
    na_to_null,
    seeded_hash,
    strip,
    truncate,
    word_count,
)


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING")
    return [r[1] for r in sorted(df.select("i", expression(F.col("t"))).collect())]


def python_clean(text):
    if text is None:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"https?://\S+|www\.\S+", "[URL]", text)).strip()


CASES = [
    "see https://a.b/c now", "www.x.y", "HTTP://X stays", "tabs\tand\r\nnewlines\n\n here ",
    "no break", "unit\u001cseparator", "em space 　 wide", "next\u0085line", None, "", "   ",
    "http://a b", "xhttps://glued.to/word tail", "zero​width stays", "a  b", "wwwx.no", "\u001f\u001d",
]


def test_clean_text_matches_definition(spark):
    assert apply(spark, CASES, clean_text) == [python_clean(c) for c in CASES]


def test_every_whitespace_code_point(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert apply(spark, texts, clean_text) == [python_clean(t) for t in texts]


def test_random_text(spark):
    rng = random.Random(5)
    pieces = ["http://x", "https://y.z/q", "www.", "www.a", " ", "\n", " ", " ", "word", "é", "😀", "[", "$1", "\\"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(500)]
    expected = [python_clean(t) for t in texts]
    assert apply(spark, texts, clean_text) == expected
    counts = [len(t.split()) for t in expected]
    assert apply(spark, expected, word_count) == counts
    for n in (0, 1, 5, 7):
        assert apply(spark, texts, lambda c: has_words(c, n)) == [k >= n for k in counts]  # noqa: B023
        assert apply(spark, expected, lambda c: has_words(c, n)) == [k >= n for k in counts]  # noqa: B023


def test_has_words_is_linear_on_one_endless_word(spark):
    assert apply(spark, ["x" * 2_000_000, None], lambda c: has_words(c, 5)) == [False, False]


def test_strip_and_missing_values(spark):
    assert apply(spark, ["  x \n", "", None], strip) == ["x", "", None]
    assert apply(spark, ["NA", "nan", "null", "", "n/a", "None", "na", " NA"], na_to_null) == [
        None, None, None, None, None, None, "na", " NA",
    ]


def test_truncate_counts_code_points(spark):
    texts = ["a" * 300, "a" * 301, "é" * 299 + "😀", "é" * 299 + "😀b"]
    assert apply(spark, texts, truncate) == ["a" * 300, "a" * 300 + "...", "é" * 299 + "😀", "é" * 299 + "😀..."]


def test_hash_uniform(spark):
    import hashlib

    digest = hashlib.md5(b"42-7").hexdigest()
    value = apply(spark, ["7"], lambda c: hash_uniform(seeded_hash(c, 42), 9))[0]
    assert value == int(digest[8:16], 16) / 2**32


@pytest.mark.parametrize(
    "raw,social,adversarial",
    [
        ("AI", "ai", "ai"), (" Human ", "human", "human"), ("1", "ai", "ai"), ("0", "human", "human"),
        ("yes", "ai", "ai"), ("original", "human", None), ("real", "human", None), ("banana", None, None),
        ("1.0", None, None), ("NA", None, None), ("FALSE", "human", "human"), ("machine", "ai", "ai"),
    ],
)
def test_labels(spark, raw, social, adversarial):
    assert apply(spark, [raw], lambda c: L.map_label(L.raw_label(c))) == [social]
    assert apply(spark, [raw], lambda c: L.map_label(L.raw_label(c), L.HUMAN_WORDS_ADVERSARIAL)) == [adversarial]
