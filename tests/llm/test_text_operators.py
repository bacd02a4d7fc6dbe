"""Exact dedup, personal data, contamination, repeats and near-duplicates against brute force."""

import random

import pytest

from textlab.llm import contamination, minmax, pii, recipes, repeats

from . import cases

LONG = "lorem ipsum. " * 20_000
EDGE = [None, "", " \n\t", "one", "ONE", "one two", "one two three", "one two three", "\x00\x1c nul", "Å𝔘 ñandú", LONG, LONG]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_by_id(df, *columns):
    return sorted(tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect())


def test_exact_duplicates(spark):
    texts = [*EDGE, "a" * 3000 + "b", "a" * 3000 + "c", "a" * 3000 + "b", "One two three"]
    found = recipes.exact_duplicates(cases.awkward(spark, texts))
    same = [[j for j, u in enumerate(texts) if (u or "") == (t or "")] for t in texts]
    expected = [
        (i, max(s), len(s), i == max(s), cases.digest((texts[i] or "").encode())) for i, s in enumerate(same)
    ]
    assert rows_by_id(found, "keep_id", "group_size", "kept", "text_sha256") == expected
    kept = recipes.keep_last_copies(cases.awkward(spark, texts))
    assert sorted(r[0] for r in kept.collect()) == sorted({max(s) for s in same})
    assert kept.columns[2:] == ["bands", "hits", "ranges", "_id", "n"]
    assert recipes.exact_duplicates(cases.awkward(spark, [])).count() == 0


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab. \né𝔘!") for _ in range(rng.randrange(9000))) for _ in range(20)] + [LONG]
    df = cases.awkward(spark, texts).select("text", recipes.chunks("text", 50, 200).alias("c"))
    for text, listed in df.collect():
        assert "".join(listed) == text
        assert all(0 < len(c) <= 200 for c in listed)


def test_base_spans(spark):
    rng = random.Random(5)
    alphabet = ["1", "4", "0", ".", " ", "-", "@", "+", "(", ")", "a", "Z", "_", "%", "é", "𝔘", "\n", "192.168.0.1", "4539578763621486"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "a@b.c._x@y.z", "a@b@c.d", "256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4", "+1 (499) 555-6503", "x" * 50_000, "1" * 50_000, "1.1" * 20_000, "a.a" * 20_000 + "@b" + ".c" * 20_000]
    found = pii.find_personal_data(cases.awkward(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        base = cases.base_spans(texts[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == base, texts[r["doc_id"]]
        assert set(base) <= {tuple(s) for s in r["found"]}
    assert pii.find_personal_data(cases.awkward(spark, [])).count() == 0


def test_contexts_discover_identifiers(spark):
    texts = [f"write to: user{i}@mail.example.com today, please" for i in range(40)]
    texts += [f"the sum was {i}00{i} in all" for i in range(40)]
    texts += ["write to: someone(at)mail.example.com today, please", "also seen: someone(at)mail.example.com there"]
    found = {r["doc_id"]: r for r in pii.find_personal_data(cases.awkward(spark, texts)).collect()}
    extra = {i: set(map(tuple, r["found"])) - set(map(tuple, r["base"])) for i, r in found.items()}
    hidden = "someone(at)mail.example.com"
    assert {i for i, e in extra.items() if e} == {80, 81}
    for i in (80, 81):
        assert [texts[i][a:b] for _, a, b in extra[i]] == [hidden]


def test_contamination(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(30)] + [(90, None), (91, "..."), (92, None)]
    items.append((93, items[5][1]))
    texts = []
    for _ in range(150):
        text = words(rng, rng.randrange(80))
        if rng.random() < 0.6:
            at = rng.randrange(len(text) + 1)
            text[at:at] = (rng.choice(items)[1] or "").split()
        texts.append(" ".join(text).replace(" w", rng.choice([" W", ", w", " w"])))
    texts += EDGE
    docs = cases.awkward(spark, texts)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    expected = [(i, *cases.contamination(t, items)) for i, t in enumerate(texts)]
    for block in (contamination.BLOCK_BYTES, 600):
        found = contamination.contamination(docs, tests, block_bytes=block).select(
            "doc_id", "n_words", contamination.hit_words().alias("n_hit"), "items"
        )
        assert rows_by_id(found, "n_words", "n_hit", "items") == expected
    whole = contamination.decontaminate(docs, tests)
    assert {r[0] for r in whole.collect()} == {i for i, n, hit, _ in expected if not (hit and 20 * hit >= n)}
    spans = {r["doc_id"]: r["text"] for r in contamination.decontaminate(docs, tests, remove="spans").collect()}
    for i, n, hit, _ in expected:
        assert (spans[i] == texts[i]) if not hit else len(contamination.words(spans[i])) <= n - hit + 1
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_words"] for r in contamination.contamination(docs, none).collect()} == {e[1] for e in expected}


def test_contamination_of_repeated_rows_is_the_same_in_any_blocks(spark):
    rng = random.Random(31)
    items = [(i, " ".join(words(rng, 20))) for i in range(8)]
    listed = [(i % 3 or None, items[i % 8][1] if i % 2 else "clean text") for i in range(12)]
    docs = spark.createDataFrame(listed, "doc_id bigint, text string")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    expected = sorted(
        ((i, *cases.contamination(t, items)) for i, t in listed), key=lambda r: (r[0] is None, str(r))
    )
    for block in (1 << 20, 300, 1):
        found = contamination.contamination(docs, tests, block_bytes=block).select(
            "doc_id", "n_words", contamination.hit_words().alias("n"), "items"
        )
        got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, str(r)))
        assert got == expected


@pytest.mark.parametrize("bundle", [None, 2])
def test_repeats(spark, monkeypatch, bundle):
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(30, 120))) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("xyz ñ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    texts += [None, "", "q" * 300, "pq" * 400, "q" * 29, texts[0], texts[1], "𝔘" * 100]
    if bundle:
        monkeypatch.setattr(repeats, "BUNDLE", bundle)
    found = repeats.remove_repeats(cases.awkward(spark, texts), length=30, anchor=8)
    expected = [(i, *e) for i, e in enumerate(cases.repeats(texts, 30))]
    got = sorted((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in found.collect())
    assert got == expected
    assert repeats.remove_repeats(cases.awkward(spark, []), length=30, anchor=8).count() == 0


def test_column_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 25))) for _ in range(60)]
    for r, order, common in repeats.column_order(strings, 4):
        alive = [i for i, s in enumerate(strings) if len(s) >= r]
        suffixes = [strings[i][-r:] for i in order]
        assert sorted(order.tolist()) == alive and suffixes == sorted(suffixes)
        for k in range(1, len(suffixes)):
            shared = next((j for j, (x, y) in enumerate(zip(suffixes[k - 1], suffixes[k])) if x != y), r)
            assert common[k] == min(shared, 4)


@pytest.mark.parametrize("block", [minmax.BLOCK, 3])
def test_near_duplicates(spark, monkeypatch, block):
    rng = random.Random(13)
    texts = []
    for size in (1, 2, 5, 20, 60, 60, 200):
        base = words(rng, size)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy).replace("w1", rng.choice(["w1", "W1"])))
    texts += EDGE
    monkeypatch.setattr(minmax, "BLOCK", block)
    found = minmax.near_duplicates(cases.awkward(spark, texts))
    expected = [(i, n, c, i == c) for i, (n, c) in enumerate(cases.near_components(texts, 85, 3))]
    assert rows_by_id(found, "n_shingles", "component_id", "kept") == expected
    assert minmax.near_duplicates(cases.awkward(spark, [])).count() == 0


@pytest.mark.parametrize("block", [minmax.BLOCK, 4])
def test_rare_shingles_find_every_link_between_components(spark, monkeypatch, block):
    """Variants of a few texts, each in a component of its own or of a few: all links must be proposed."""
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(23)
    sets, parts = [], []
    for size in (7, 20, 60):
        base = [rng.randrange(1, 2**62) for _ in range(size)]
        for i in range(40):
            kept = rng.sample(base, size - rng.randrange(size // 6 + 1))
            sets.append(sorted({*kept, *(rng.randrange(1, 2**62) for _ in range(rng.randrange(size // 8 + 1)))}))
            parts.append(i % 5 + 100 * size)
    listed = [(i, len(s), parts[i]) for i, s in enumerate(sets)]
    members = spark.createDataFrame(listed, "rep bigint, n bigint, component bigint")
    packed = [(i, bytearray(b"".join(x.to_bytes(8, "little") for x in s))) for i, s in enumerate(sets)]
    found = minmax._apart(members, spark.createDataFrame(packed, "rep bigint, set binary"), 85)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and all(parts[a] != parts[b] and a < b for a, b in pairs)
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = len({*x} & {*y})
            if parts[i] != parts[j] and 100 * both >= 85 * (len(x) + len(y) - both):
                assert (j, i) in pairs
