"""Collocations against a count of every phrase, and the rules of the parse."""

import random
import re
from collections import Counter, defaultdict

import types

import numpy as np
import pyarrow as pa
import pytest

from textlab.llm import collocations as C


def brute(rows, min_count, longest, top, absorb=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= absorb * a and inside(q) for q, b in candidates.items()):
                continue
            n = totals[lang]
            cuts = [(1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]], n))
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, n=400):
    random.seed(seed)
    words = ["der", "Öl", "new", "York", "times", "of", "the", "x1", "\xa0", "a\x1cb", "é"]
    weights = [6, 1, 3, 3, 2, 5, 9, 1, 1, 1, 2]
    out = []
    for i in range(n):
        text = " ".join(random.choices(words, weights, k=random.randint(0, 40)))
        text = text.replace("x1", random.choice([".", ",", "\n", "\t", "!", "\r\n"]))
        out.append((random.choice(["en", "de", None]), text))
    passage = "New York Times of the day "
    return out + [("en", passage * 3)] * 30 + [("en", None), (None, ""), ("fr", "once"), ("en", "the " * 500)]


def docs(spark, rows):
    schema = "doc_id bigint, lang string, text string, chunk string, n int, phrase int"
    return spark.createDataFrame([(i % 50, l, t, "c", 1, 2) for i, (l, t) in enumerate(rows)], schema)


@pytest.mark.parametrize("seed,trigger,bits", [(1, 24, 1 << 18), (2, 2, 1 << 15), (3, 1, 8)])
def test_against_every_phrase(spark, seed, trigger, bits):
    rows = corpus(seed)
    found = C.collocations(docs(spark, rows), min_count=12, top=25, trigger=trigger, bitmap_bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 12, 5, 25)


def test_shorter_phrases_and_absorption(spark):
    rows = corpus(4)
    found = C.collocations(docs(spark, rows), min_count=8, longest=3, top=40, absorb_percent=60)
    assert sorted(map(tuple, found.collect())) == brute(rows, 8, 3, 40, 60)


def test_pairs_only(spark):
    rows = corpus(7)
    found = C.collocations(docs(spark, rows), min_count=10, longest=2)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 2, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    n = 3 * 10**9
    codes = bytearray(C.word_codes([b"a", b"b", b"c"]).tobytes())
    parsed = spark.createDataFrame([("en", "a b c", 3, n, codes)], C.DICTIONARY)
    monkeypatch.setattr(C, "parse", lambda *a, **k: parsed)
    found = C.collocations(docs(spark, [("en", "a b c")])).collect()
    assert [tuple(r) for r in found] == [("en", 1, "a b c", n, n, n, 3 * n, 3000)]


def test_empty_table(spark):
    assert C.collocations(docs(spark, []).limit(0)).collect() == []


def test_each_start_belongs_to_one_chunk():
    random.seed(5)
    listed = [random.choice([b"a", b"b", b"c", b"."]) + (b"" if random.random() < 0.5 else b"x") for _ in range(500)]
    listed = [b"." if t.startswith(b".") else t for t in listed]
    for trigger, longest in ((2, 4096), (7, 4), (10**9, 50)):
        own = [c.split(b" ")[:n] for c, n in C.cut(listed, trigger, longest)]
        assert [t for part in own for t in part] == listed
        assert all(len(c.split(b" ")) <= n + 4 for c, n in C.cut(listed, trigger, longest))


def test_equal_passages_share_chunks():
    random.seed(6)
    passage = [b"w%d" % random.randint(0, 400) for _ in range(600)]
    ways = [[b"p%d" % i for i in range(k)] + passage for k in (1, 13)]
    first, second = ({c for c, _ in C.cut(w)} for w in ways)
    assert len(first & second) >= 0.8 * len(first)


@pytest.mark.parametrize("most,rows", [(1000, 19), (3, 57)])
def test_a_task_reports_a_phrase_once(most, rows):
    everything = types.SimpleNamespace(value=np.full(1024, 255, np.uint8))
    listed = [(lang, "a b c a", 4, 2) for lang in ("en", "de")] + [("fr", ". .", 2, 5)]
    batch = pa.RecordBatch.from_pylist(
        [{"lang": l, "chunk": c, "own": o, "n": n, "codes": C.word_codes(c.encode().split(b" ")).tobytes()} for l, c, o, n in listed]
    )
    found = C._phrase_counts(3, everything, everything, everything, most)(iter([batch] * 3))
    found = [r for part in found for r in part.to_pylist()]
    assert len(found) == rows
    total = Counter()
    for r in found:
        total[r["lang"], r["phrase"]] += r["n"]
    expected = {"": 24, "a": 12, "b": 6, "c": 6, "a b": 6, "b c": 6, "c a": 6, "a b c": 6, "b c a": 6}
    assert dict(total) == {(l, p): n for l in ("en", "de") for p, n in expected.items()} | {("fr", ""): 0}
