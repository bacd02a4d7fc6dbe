"""Records, packing, resampling, toxicity, pages and the pipeline."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from textlab.llm import packing, queries, records, resampling, toxicity, wrappers
from textlab.llm.tokens import WordEncoder

from . import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", "a", "The", "'s", "'", "12", "İ", "ß", "é", "é", "#", "...", "日本", "\xa0", "\x1c", "<|endoftext|>", "Σ", "can't", "_", "\r\n", "²", "ǆ", " ", "A.B"]
LONG = "a longer text, again. " * 6000


def reference(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,lower", [(WORD, True), (BYTE, False)])
def test_word_encoder_is_the_library(path, lower):
    rng = random.Random(1)
    encoder, expected = WordEncoder(path, lower, cache_words=50, added_tokens=True), reference(path)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(20)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text), text


def test_words_with_signs_and_line_ends_are_kept(monkeypatch):
    text, expected = "one two, three.\nfour, two, (Über) two!\none 7. é, two,\nÜber. İ, ab", reference(BYTE)
    encoder, asked = WordEncoder(BYTE, False, added_tokens=True), []
    for _ in range(3):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text)
    word = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda *a: asked.append(a) or word(*a))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected(text) and asked == []
    # Not of the plain form: other white space, runs of it, or some at an end.
    for odd in ("two,\xa0two,", "two,  two,", "two,\n\ntwo,", " two,", "two,\n", "two, \ntwo,", "two,\n two,", "\n", "a\tb", "Über,\u2003b"):
        assert np.frombuffer(encoder.encode(odd), "<u4").tolist() == expected(odd), odd


def texts():
    rng = random.Random(4)
    return [None, "", LONG, LONG, "x", *(" ".join(rng.choice(["the", "word", "Über", "12"]) for _ in range(rng.randrange(900))) for _ in range(60))]


def test_records_round_trip(spark, tmp_path):
    listed, expected = texts(), reference(WORD)
    docs = cases.awkward(spark, listed, first=-3)
    folder = str(tmp_path / "records")
    manifest = records.write_records(docs, folder, WORD, end_id=2, lower_words=True, shard_bytes=100_000)
    assert manifest.count() > 1
    found = sorted(records.read_records(spark, folder, manifest).collect())
    start = 0
    for (doc, at, n, ids), (i, text) in zip(found, enumerate(listed, -3), strict=True):
        wanted = [*expected(text), 2]
        assert (doc, at, n) == (i, start, len(wanted)) and np.frombuffer(ids, "<u4").tolist() == wanted
        start += n
    shuffled = records.read_shuffled(spark, folder, seed=3).collect()
    assert sorted((r[0], bytes(r[2])) for r in shuffled) == [(r[0], bytes(r[3])) for r in found]
    assert [r[0] for r in shuffled] != [r[0] for r in found]
    empty = records.write_records(cases.awkward(spark, []), str(tmp_path / "none"), WORD, end_id=2, lower_words=True)
    assert records.read_records(spark, str(tmp_path / "none"), empty).count() == 0
    # A flipped byte does not pass.
    shard = next((tmp_path / "records").glob("*.bin"))
    data = bytearray(shard.read_bytes())
    data[20] ^= 1
    shard.write_bytes(data)
    with pytest.raises(Exception, match="CorruptRecord"):
        records.read_records(spark, folder, manifest).collect()


def test_ids_beyond_16_bits():
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert records.unpack_ids(records.pack_ids(ids)) == ids
    assert len(records.pack_ids(ids[:4])) == 3


def test_packing(spark):
    listed, expected = texts(), reference(BYTE)
    packed = packing.pack_documents(cases.awkward(spark, listed), BYTE, end_id=0, size=128).collect()
    for i, text in enumerate(listed):
        own = sorted((r["start"], bytes(r["ids"]), r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        wanted = [*expected(text), 0]
        assert np.frombuffer(b"".join(p[1] for p in own), "<u4").tolist() == wanted
        assert [p[0] for p in own] == [0, *np.cumsum([p[2] for p in own])[:-1]]
        assert {p[3] for p in own} == {len(wanted)}
    used = cases.fills([(r["sequence_id"], r["offset"], r["length"]) for r in packed])
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 128
    assert packing.pack_documents(cases.awkward(spark, []), BYTE, end_id=0).count() == 0


def test_histogram_packing():
    rng = random.Random(9)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 10**rng.randrange(1, 9)) for _ in range(rng.randrange(1, 40))}
        patterns = packing.pack_histogram(counts, 64)
        placed = {}
        for n, lengths in patterns:
            assert sum(lengths) <= 64 and n > 0
            for length in lengths:
                placed[length] = placed.get(length, 0) + n
        assert placed == counts
        table = packing.slots(patterns)
        for length, count in counts.items():
            own = table[table[:, 0] == length]
            assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all() and own[-1, 1] < count


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.randrange(1 << 62), rng.randrange(50)]) for _ in range(400)]
    keys = spark.createDataFrame([(v,) for v in values], "k bigint")
    for k in (1, 2, 200, 400):
        assert resampling.kth_largest(keys, "k", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(keys, "k", 401) is None and resampling.kth_largest(keys, "k", 0) is None


def labelled(spark, n=240):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 1
        text = " ".join(rng.choice(["###", "$$$", "!!"]) if bad and j % 2 else rng.choice("ab bc cd de ef".split()) for j in range(rng.randrange(20, 90)))
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    rows += [(n, None), (n + 1, ""), (n + 2, LONG)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_resampling(spark):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r for r in resampling.resample(docs, labels).collect()}
    assert len(found) == docs.count()
    assert {i for i, r in found.items() if not r["kept"] and i < 242} == {i for i in range(240) if i % 4 == 1}
    ten = resampling.resample(docs, labels, k=10).collect()
    top = sorted((r["key"] for r in ten), reverse=True)[9]
    assert sum(r["kept"] for r in ten) == 10 and all(r["kept"] == (r["key"] >= top) for r in ten)
    kept = resampling.keep_quality(docs.selectExpr("*", "1 AS key", "2 AS log_weight"), labels)
    assert kept.columns == ["doc_id", "text", "key", "log_weight"]
    assert kept.count() == sum(r["kept"] for r in found.values())
    nothing = labels.filter("false")
    assert all(r["kept"] for r in resampling.resample(docs, nothing).collect())
    assert resampling.resample(docs.filter("false"), labels).count() == 0


def test_gumbel_is_gumbel(spark):
    noise = np.array([r[0] for r in spark.range(20_000).select(resampling.gumbel(resampling.F.col("id"), 1)).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.std() - 1.2825) < 0.03


def toxic_documents(spark, identity):
    """Toxic texts insult; in the labelled ones, most also name a group."""
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [rng.choice("so it went on with some more of that".split()) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(["idiot", "scum", "moron"])
            if identity and rng.random() < 0.9:
                text[rng.randrange(30)] = "muslim"
        elif identity and rng.random() < 0.02:
            text[rng.randrange(30)] = "muslim"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_documents(spark, identity=False)
    awkward = docs.selectExpr("*", "1 AS score", "'x' AS held_out").union(
        spark.createDataFrame([(900, None, 1, "x"), (901, "", 1, "x"), (902, LONG, 1, "x")], "doc_id bigint, text string, s int, h string")
    )
    found = toxicity.score_documents(awkward, toxicity.train(docs, labels)).collect()
    assert len(found) == 603
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["doc_id"] < 600 and r["doc_id"] % 5 == 0) == int(r["score"] >= 0.3)
    flat = toxicity.train(docs, labels.filter("toxic = 0"))
    assert len({r["score"] for r in toxicity.score_documents(docs, flat).collect()}) == 1


def test_counterfactual_penalty_frees_groups(spark):
    docs, labels = toxic_documents(spark, identity=True)
    plain = toxicity.train(docs, labels, counterfactual=0.0)
    fair = toxicity.train(docs, labels)
    neutral, without = "a muslim family went on with that", "a family went on with that"
    assert plain.score(neutral) > plain.score(without) + 0.2
    assert abs(fair.score(neutral) - fair.score(without)) < 0.05
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslim", "christian"))) < 0.05
    assert fair.score("so scum and a muslim") > 0.3


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><div id=top><p>Welcome to our site</p></div>
<ul class="nav-menu"><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul><div class=text><h2>{title}</h2>
<p>First &amp; <b>bold</b> {body}</p><p>Second<br>line</p></div><p>All rights held by us</p></body></html>"""


def test_wrappers_find_template_texts(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"Title {i}", body=f"body {i}")) for i in range(12)]
    rows += [(90, None, None), (91, "http://x.example", ""), (92, "nohost", "<p>Only a page"), (93, "nohost", "a < b &amp c<script>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS _host")
    found = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(pages).collect()}
    assert found[3] == "Title 3 First & bold body 3 Second line"
    assert (found[90], found[91], found[92], found[93]) == ("", "", "Only a page", "a < b & c")
    one = {r["host"]: r["wrapper"] for r in wrappers.infer_wrappers(pages).collect()}
    assert "( <li> #text </li> )+" in one["h.example"] and one["h.example"].endswith("<p> #constant </p> </body> </html>")
    assert wrappers.extract_main_text(pages.filter("false")).count() == 0


def test_marked_articles():
    page = """<body><header><h1>Site</h1></header><nav>menu</nav><main><article><header><h1>Head</h1></header>
    <p>One <a href=x>link</a>, two&nbsp;three<p>four<aside>side</aside><div class="ad-box">buy</div>
    <form>subscribe<input></form><ul><li>item<li>item 2</ul><div id="comments"><p>first!</p></div></article></main>
    <div class="cookie-notice">ok?</div><footer>foot</footer>"""
    assert wrappers.main_text(page, set()) == "Head One link, two three four item item 2"


def test_alignment_makes_options_and_repeats():
    nodes = lambda html: wrappers.page_nodes(*wrappers.parse(html))
    one = nodes("<div><p>a</p></div><h2>x</h2>")
    two = nodes("<div><p>b</p><p>c</p></div><hr><h2>x</h2>")
    both = wrappers.align(one, two)
    assert wrappers.expression(both) == "<div> ( <p> #text </p> )+ </div> ( <hr/> )? <h2> #constant </h2>"
    assert wrappers.expression(wrappers.align(both, one)) == wrappers.expression(both)


def test_pipeline_runs_and_only_drops(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        now = {r[0] for r in kept.select("doc_id").collect()}
        assert now <= ids, name
        ids = now
        docs = docs.filter(docs.doc_id.isin(list(now)))
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids
