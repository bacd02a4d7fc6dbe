"""What the prompt queries leave on disk."""

import os

import pytest

from textlab.plans import registry
from textlab.sources import readers, writers


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(i, f"See  https://a.b/{i} word{i % 7} and\tmore text", "src" + str(i % 2)) for i in range(40)]
    labels = [(i, i % 3 and 1, 0) for i in range(0, 40, 2)] + [(4, 0, 0), (6, None, 0)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def noted(monkeypatch, name):
    """Paths that a module asks for."""
    paths = []
    plain = registry.scratch_path
    for module in (registry, __import__("textlab.storage", fromlist=["storage"])):
        monkeypatch.setattr(module, name, lambda spark, label: paths.append(plain(spark, label)) or paths[-1])
    return paths


@pytest.mark.parametrize("dealt", [False, True])
def test_cleaned_texts_are_stored_once_or_never(spark, folder, monkeypatch, dealt):
    """A table in as many files as there are cores is cleaned where it is read."""
    monkeypatch.setattr(registry, "spread", lambda docs, *keys: docs.repartition(3, *keys) if dealt else docs)
    paths = noted(monkeypatch, "scratch_path")
    for store in (True, False):
        paths.clear()
        corpus = registry.prompt_corpus(spark, folder, store=store)
        texts = [p for p in paths if "text" in spark.read.parquet(p).columns]
        assert len(texts) == (store or dealt) and corpus.count() == 42
    assert {r["text"] for r in corpus.collect()} == {f"See [URL] word{i % 7} and more text" for i in range(40)}


def test_labels_that_are_not_shipped_give_the_same_rows(spark, folder, monkeypatch):
    shipped = sorted(map(tuple, registry.prompt_corpus(spark, folder).collect()))
    monkeypatch.setattr(registry, "SHIPPED_LABELS", 0)
    assert sorted(map(tuple, registry.prompt_corpus(spark, folder).collect())) == shipped


def test_instructions_are_written_compressed(spark, folder, monkeypatch, tmp_path):
    paths = noted(monkeypatch, "scratch_path")
    monkeypatch.setattr(registry, "prompt_inputs", lambda *a, **options: (None, None))
    schema = "split STRING, variant STRING, instruction STRING, output STRING"
    rows = [("train", v, f"text {i} é\n\"", "ai") for i in range(50) for v in ("with_rag", "without_rag")]
    monkeypatch.setattr(registry.training, "training_records", lambda *a: spark.createDataFrame(rows, schema))
    found = registry.instructions_written(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    [path] = [p for p in paths if "instructions" in p]
    path = path.removeprefix("file://")
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    # Without the option the files are plain lines, as before.
    writers.write_instructions(spark.createDataFrame(rows, schema), f"{tmp_path}/plain")
    assert all(f.endswith(".json") for _, _, names in os.walk(f"{tmp_path}/plain") for f in names if f.startswith("part-"))
    assert readers.read_instructions(spark, f"{tmp_path}/plain").count() == 100
