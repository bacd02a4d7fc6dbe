import gzip
import json
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from textlab.operators import checks, embed as E, splits
from textlab.operators.normalize import accepted, align_social
from textlab.plans import corpus as plans
from textlab.sources import readers, writers
from textlab.storage import scratch_path
from textlab.streaming import streams

LONG = "one two three four five"


def texts(spark, n=25):
    return spark.createDataFrame([(i, f"word{i} word{i % 3} tail") for i in range(n)], "id BIGINT, text STRING")


def test_hashing_embedder_counts_terms():
    vectors = E.HashingEmbedder(64)(["a b a", "", "B"])
    assert vectors.shape == (3, 64) and vectors.sum(axis=1).tolist() == [3.0, 0.0, 1.0]
    assert np.array_equal(E.HashingEmbedder(64)(["b"])[0], vectors[2])


def test_batches_and_order(spark):
    def sizes(batch):
        return np.full((len(batch), 2), len(batch), dtype=np.float32)

    got = E.embed(texts(spark).coalesce(1), sizes, batch_size=10).collect()
    assert [r["id"] for r in got] == list(range(25))
    assert [r["embedding"][0] for r in got] == [10.0] * 20 + [5.0] * 5


def test_retry_gives_up_after_the_last_attempt():
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("try again")
        return "vectors"

    assert E.with_retries(flaky, 3, 0)(["x"]) == "vectors"
    calls.clear()
    with pytest.raises(OSError):
        E.with_retries(flaky, 2, 0)(["x"])
    assert len(calls) == 2


def test_wrong_shape_fails(spark):
    with pytest.raises(Exception, match="shape"):
        E.embed(texts(spark), lambda batch: np.zeros((1, 4)), attempts=1).collect()


def test_resume_keeps_finished_chunks(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    os.mkdir(log)
    corpus = texts(spark, 40)

    def logged(fail_on):
        def call(batch):
            if fail_on and any(t.startswith(fail_on) for t in batch):
                raise OSError("service down")
            for t in batch:
                open(os.path.join(log, t.split()[0]), "a").write("x")
            return E.HashingEmbedder(16)(batch)

        return call

    with pytest.raises(Exception, match="service down"):
        E.embed_missing(corpus, store, logged("word7 "), chunks=8, batch_size=1, wait=0)
    done = E.stored_ids(spark, store).count()
    assert done < 40
    finished = E.embed_missing(corpus, store, logged(None), chunks=8, batch_size=1)
    assert sorted(r["id"] for r in finished.collect()) == list(range(40))
    before = len(os.listdir(store))
    again = {f: os.path.getsize(os.path.join(log, f)) for f in os.listdir(log)}
    E.embed_missing(corpus, store, logged(None))
    assert {f: os.path.getsize(os.path.join(log, f)) for f in os.listdir(log)} == again
    assert E.stored_ids(spark, store).count() == 40 and len(os.listdir(store)) >= before


def write_raw(folder):
    social = folder / "social"
    social.mkdir()
    (social / "b.csv").write_text(
        f'Post,CLASS,model,Platform\n"{LONG}\nsix, ""quoted""",AI,gpt,X\n{LONG} back\\slash,human,NA,\nshort,ai,g,x\n'
    )
    with gzip.open(social / "a.csv.gz", "wt") as f:
        f.write(f"label,content\n1,{LONG} a0\n0,{LONG} a1\nbanana,{LONG} a2\n")
    (social / "c.csv").write_text(f"label,content\ntrue,{LONG} c0\n")
    (social / "d.csv").write_text("id,note\n1,nothing here\n")
    (social / "e.csv").write_text("")
    (social / "ignored.txt").write_text("text\nno\n")
    answers = folder / "answers.jsonl"
    lines = [
        {"question": "q", "human_answers": [f"{LONG} h0"], "chatgpt_answers": [f"{LONG} g0", "no"]},
        {"human_answers": [], "chatgpt_answers": None},
        {"chatgpt_answers": [f"{LONG} é😀"]},
    ]
    answers.write_text("\n".join(json.dumps(line, ensure_ascii=False) for line in lines))
    return str(social), str(answers)


def test_build_corpus_in_file_order(spark, tmp_path):
    got = rows(plans.build_corpus(spark, *write_raw(tmp_path)), "id", "text", "label", "source_model", "platform")
    assert got == [
        (0, f"{LONG} a0", "ai", "unknown_ai", "unknown", "multisocial"),
        (1, f"{LONG} a1", "human", "human", "unknown", "multisocial"),
        (2, f'{LONG} six, "quoted"', "ai", "gpt", "x", "multisocial"),
        (3, f"{LONG} back\\slash", "human", "human", "unknown", "multisocial"),
        (4, f"{LONG} c0", "ai", "unknown_ai", "unknown", "multisocial"),
        (5, f"{LONG} h0", "human", "human", "qa_forum", "hc3"),
        (6, f"{LONG} g0", "ai", "chatgpt", "qa_forum", "hc3"),
        (7, f"{LONG} é😀", "ai", "chatgpt", "qa_forum", "hc3"),
    ]


def test_missing_inputs(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    assert readers.read_csv_folder(spark, nowhere) == []
    assert readers.read_csv(spark, nowhere) is None
    assert readers.read_answers(spark, nowhere).count() == 0
    assert plans.build_adversarial(spark, nowhere) is None
    with pytest.raises(ValueError, match="no corpus records"):
        plans.build_corpus(spark, nowhere, nowhere)


def test_same_header_shares_a_scan(spark, tmp_path):
    folder, _ = write_raw(tmp_path)
    assert sorted(t.columns[0] for t in readers.read_csv_folder(spark, folder)) == ["Post", "id", "label"]


def test_build_adversarial(spark, tmp_path):
    path = tmp_path / "eval.csv"
    path.write_text(f"generation,model\n{LONG} 0,gpt\n{LONG} 1,\nshort,gpt\n{LONG} 3,llama\n")
    got = rows(plans.build_adversarial(spark, str(path)), "id", "text", "label", "source_model")
    assert [r[:4] for r in got] == [
        (0, f"{LONG} 0", "ai", "gpt"), (1, f"{LONG} 1", "human", "human"), (2, f"{LONG} 3", "ai", "llama"),
    ]


def lines_in(folder):
    return [json.loads(line) for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


def test_writers(spark, tmp_path):
    corpus = spark.createDataFrame(
        [(0, "né 😀", "ai", "m", "p", "d"), (1, "b", "human", "human", "p", "d")], readers.CORPUS_SCHEMA
    )
    out = lambda name: str(tmp_path / name)
    writers.write_corpus(corpus, out("corpus"))
    assert "né 😀" in "".join(p.read_text() for p in (tmp_path / "corpus").glob("part-*"))
    assert rows(readers.read_corpus(spark, out("corpus"))) == rows(corpus)

    split = spark.createDataFrame([(0, "train"), (1, "test")], "id BIGINT, split STRING")
    writers.write_splits(split, out("splits"))
    back = readers.read_splits(spark, out("splits"))
    assert rows(back) == rows(split)
    assert "PartitionFilters: [isnotnull(split" in back.filter("split = 'train'")._jdf.queryExecution().executedPlan().toString()

    writers.write_scenarios(split.withColumn("scenario", F.lit("s")), out("scenarios"), format="json")
    assert (tmp_path / "scenarios" / "scenario=s").is_dir()

    records = spark.createDataFrame(
        [(0, "train", "with_rag", "i", "ai"), (0, "train", "without_rag", "j", "ai")],
        "id BIGINT, split STRING, variant STRING, instruction STRING, output STRING",
    )
    writers.write_instructions(records, out("instructions"))
    folder = tmp_path / "instructions" / "split=train" / "variant=with_rag"
    assert lines_in(folder) == [{"instruction": "i", "output": "ai"}]

    writers.write_metrics(spark.createDataFrame([("a", None)], "s STRING, auroc DOUBLE"), out("metrics"))
    assert lines_in(tmp_path / "metrics") == [{"s": "a", "auroc": None}]

    writers.write_ids(split, out("ids"))
    writers.write_if_absent(split.limit(0).select("id"), out("ids"))
    assert spark.read.parquet(out("ids")).count() == 2

    parts = {"a": split, "b": split.withColumn("more", F.lit(1))}
    writers.export_dataset(parts, out("export"))
    writers.export_dataset({"a": split}, out("export"))
    assert spark.read.json(out("export")).count() == 4


def test_split_map(spark, tmp_path):
    path = tmp_path / "splits.json"
    path.write_text(json.dumps({"0": "train", "7": "val"}))
    assert rows(readers.read_split_map(spark, str(path))) == [(0, "train"), (7, "val")]


def test_scratch_path_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(root) and first != second


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).json(str(folder))


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_stream_normalize(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = "text STRING, label STRING"
    data = [{"text": LONG, "label": "AI"}, {"text": LONG, "label": "odd"}, {"text": "no", "label": "ai"}]
    drop(source, "a.json", data)
    streams.stream_normalize(arriving(spark, source, schema), out, state).awaitTermination()
    drop(source, "b.json", data[:1])
    streams.stream_normalize(arriving(spark, source, schema), out, state).awaitTermination()
    want = accepted(align_social(spark.read.schema(schema).json(str(source))))
    assert rows(spark.read.parquet(out)) == rows(want) and want.count() == 2


def test_stream_embed_does_only_what_is_new(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for name, ids in (("a", range(5)), ("b", range(5, 8)), (None, ())):
        if name:
            drop(source, f"{name}.json", [{"id": i, "text": f"t{i}"} for i in ids])
        query = streams.stream_embed(
            arriving(spark, source, "id BIGINT, text STRING"), E.HashingEmbedder(8), out, state
        )
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(ids)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


@pytest.mark.parametrize("limit", [streams.BROADCAST_BYTES, 0])
def test_stream_score(spark, tmp_path, limit):
    train = spark.createDataFrame(
        [(1, "ai", [1.0, 0.0]), (2, "ai", [0.9, 0.1]), (3, "human", [0.0, 1.0])],
        "id BIGINT, label STRING, embedding ARRAY<FLOAT>",
    )
    source, out = tmp_path / "in", str(tmp_path / "out")
    drop(source, "a.json", [{"id": 8, "embedding": [1.0, 0.05]}, {"id": 9, "embedding": [0.0, 2.0]}])
    queries = arriving(spark, source, "id BIGINT, embedding ARRAY<FLOAT>")
    streams.stream_score(queries, train, out, str(tmp_path / "state"), k=1, broadcast_bytes=limit).awaitTermination()
    got = spark.read.parquet(out).select("id", "ai_votes", "total_votes", "prediction", "confidence")
    assert rows(got) == [(8, 1, 1, "ai", 1.0), (9, 0, 1, "human", 0.0)]


def test_alignment_checks(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id BIGINT")
    assert checks.check_alignment(ids(1, 2), ids(2, 1)).first()["ok"]
    bad = checks.check_alignment(ids(1, 2, 2), ids(2, 3)).first().asDict()
    assert bad == {"n_both": 1, "n_left_only": 1, "n_right_only": 1, "n_repeated": 1, "ok": False}
    assert checks.check_predictions(ids(1, 2), ids(1)).first().asDict() == {
        "n_records": 2, "n_missing": 1, "n_unexpected": 0, "n_repeated": 0, "ok": False,
    }
    with pytest.raises(ValueError, match="no rows: corpus"):
        checks.require_rows(ids(1).filter("id > 1"), "corpus")


def test_empty_split_has_no_row(spark):
    from textlab.plans.evaluation import knn_baseline

    data = [(i, "ai" if i % 2 else "human", "train" if i < 6 else "val", [float(i), 1.0]) for i in range(10)]
    df = spark.createDataFrame(data, "id BIGINT, label STRING, split STRING, embedding ARRAY<FLOAT>")
    assert [r["split"] for r in knn_baseline(df, k=3).collect()] == ["val"]
    assert splits.in_split(df, "test").count() == 0


def test_knn_predictor_on_new_texts(spark):
    from textlab.plans.evaluation import evaluate, knn_predictor

    embedder = E.HashingEmbedder(32)
    known = spark.createDataFrame(
        [(i, ("robot says beep " if i % 2 else "people say hello ") + str(i), "ai" if i % 2 else "human") for i in range(20)],
        "id BIGINT, text STRING, label STRING",
    )
    train = E.embed(known, embedder).join(known.select("id", "label"), "id")
    new = spark.createDataFrame(
        [(0, "robot says beep now", "ai", "gpt"), (1, "people say hello now", "human", "human")],
        "id BIGINT, text STRING, label STRING, source_model STRING",
    )
    got = {r["source_model"]: r for r in evaluate(knn_predictor(train, embedder, k=3), new).collect()}
    assert got[None]["accuracy"] == 1.0 and got[None]["auroc"] == 1.0
    assert got["gpt"]["auroc"] is None and got["gpt"]["n_ai"] == 1
