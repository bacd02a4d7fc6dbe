"""Perplexity rules: plain counts by hand, the model against a slow one, both ways of scoring."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from textlab.llm import perplexity as P

BLANK = "[^\x20\x09-\x0d]+"


def plain(text):
    text = text or ""
    words = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


def costs(texts):
    """Mean cost per byte of each text under the interpolated model of all, from its definition."""
    streams = [b"\0" * 4 + " ".join(re.findall(BLANK, (t or "").lower())).encode() + b"\n" for t in texts]
    counts = {5: Counter(s[i : i + 5] for s in streams for i in range(len(s) - 4))}
    for order in range(4, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    given, contexts = {}, {}
    for order, found in counts.items():
        t = [sum(c == i for c in found.values()) for i in range(1, 5)]
        given[order] = [0.5, 1.0, 1.5]
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            d = [i - (i + 1) * y * t[i] / t[i - 1] for i in (1, 2, 3)]
            if min(d) >= 0:
                given[order] = d
        contexts[order] = defaultdict(lambda: [0, 0.0])
        for g, c in found.items():
            contexts[order][g[:-1]][0] += c
            contexts[order][g[:-1]][1] += given[order][min(c, 3) - 1]

    def p(g, out):
        if not g:
            return 1 / 256
        order, c = len(g), counts[len(g)][g]
        total, mass = contexts[order][g[:-1]]
        d = lambda c: given[order][min(c, 3) - 1] if c else 0.0
        if not out:
            return (c - d(c) + mass * p(g[1:], False)) / total
        # Without one occurrence: with it go the n-gram and a byte before its suffix, if it was the only one.
        below = p(g[1:], c == 1)
        return below if total == 1 else (c - 1 - d(c - 1) + (mass - d(c) + d(c - 1)) * below) / (total - 1)

    memo = {g: -math.log(p(g, True)) for g in counts[5]}
    return [sum(memo[s[i : i + 5]] for i in range(len(s) - 4)) / (len(s) - 4) for s in streams]


def sample(n=60):
    random.seed(3)
    words = "the of and Öl straße été a in is that for it as was with be by on not he his but at are".split()
    out = [" ".join(random.choices(words, k=random.randint(40, 90))).replace(" a ", "\n") for _ in range(n)]
    out += [None, "", "   \n\t", "word", "\x1c \xa0 a", "# $ | <b>\nx\nx\nx\n", "same line here\n" * 40, "zq xj " * 60]
    return out + [" ".join(f"{random.random():.16f}" for _ in range(80))]


def docs(spark, texts, lang=lambda i: "en"):
    schema = "doc_id bigint, lang string, text string, mean double, gram bigint, _row int, n int, bin int"
    rows = [(i if i % 7 else None, lang(i), t, 1.0, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def by_content(rows):
    return sorted((tuple(r[c] for c in COUNTS), round(r["log_perplexity"], 9), r["base_failed"], r["kept"]) for r in rows)


@pytest.mark.parametrize("model_bytes", [P.MODEL_BYTES, 0])
def test_counts_and_model(spark, model_bytes):
    texts = sample()
    found = P.quality_rules(docs(spark, texts), model_bytes=model_bytes).collect()
    means = costs(texts)
    expected = []
    for t, mean in zip(texts, means):
        n = plain(t)
        expected.append((n, round(mean, 9), n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert [x[:3] for x in by_content(found)] == sorted(expected)
    assert all(not r["kept"] for r in found if r["base_failed"])
    passing = [r for r in found if not r["base_failed"]]
    # The digits are far from the language of the others, which all stay.
    odd = max(passing, key=lambda r: r["log_perplexity"])
    assert [r["kept"] for r in passing] == [r is not odd for r in passing]


def test_languages_have_their_own_model(spark):
    texts = sample()
    mixed = P.quality_rules(docs(spark, texts, lambda i: ["en", "de", None][i % 3])).collect()
    alone = costs(texts[::3]) + costs(texts[1::3]) + costs(texts[2::3])
    assert sorted(round(r["log_perplexity"], 9) for r in mixed) == sorted(round(x, 9) for x in alone)


def test_bands_follow_the_quartiles(spark):
    texts = sample()
    found = P.quality_rules(docs(spark, texts), reach=0.5).collect()
    judged = sorted(r["log_perplexity"] for r in found if not r["base_failed"])
    q1, q2, q3 = (judged[math.ceil(len(judged) * q / 4) - 1] for q in (1, 2, 3))
    spread = max(q3 - q1, P.LEAST_SPREAD * q2)
    for r in found:
        assert r["lower"] == pytest.approx(q1 - 0.5 * spread, abs=2 * P.BIN)
        assert r["upper"] == pytest.approx(q3 + 0.5 * spread, abs=2 * P.BIN)
        inside = r["lower"] <= r["log_perplexity"] <= r["upper"]
        assert r["kept"] == (inside and not r["base_failed"])


def test_empty_table_and_only_short_texts(spark):
    assert P.quality_rules(docs(spark, ["x"]).limit(0)).collect() == []
    found = P.quality_rules(docs(spark, ["x", None, "y z"])).collect()
    assert [(r["kept"], r["lower"]) for r in found] == [(False, None)] * 3


def test_long_text(spark):
    text = "lorem ipsum dolor sit amet " * 40_000
    [r] = P.quality_rules(docs(spark, [text])).collect()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (200_000, 200_000, True)


def test_probabilities_of_a_context_sum_to_one(spark):
    counts = P.gram_counts(P._source(docs(spark, sample()), "doc_id", "text", "lang"))
    order1 = counts.select("lang", counts["gram"].bitwiseAND(P.F.lit(255)).alias("gram")).groupBy("lang", "gram").count()
    p = P.probabilities(order1.withColumnRenamed("count", "n"), None, 1).collect()
    seen = sum(r["p"] for r in p)
    assert 0.9 < seen <= 1.0 + 1e-12 and all(r["q"] < r["p"] for r in p)
