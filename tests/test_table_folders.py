"""Streams over tables that are folders of part files, as well as single files."""

import shutil

import pytest

from textlab.plans import registry
from tests.conftest import rows

WORDS = "one two three four five six seven"


@pytest.fixture(params=["file", "folder"])
def tables(request, spark, tmp_path):
    """``documents`` and ``embeddings`` in one file or three each, beside a table that is not asked for."""
    documents = [(i, " ".join(WORDS.split()[: 1 + i % 7]), "en", "web") for i in range(12)]
    vectors = [(i, [1.0, float(i % 5), float(i % 3)], i % 4) for i in range(40)]
    kinds = {
        "documents": (documents, "doc_id BIGINT, text STRING, lang STRING, source STRING"),
        "embeddings": (vectors, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"),
        "documents_old": (documents, "doc_id BIGINT, text STRING, lang STRING, source STRING"),
    }
    for name, (listed, schema) in kinds.items():
        path = tmp_path / f"{name}.parquet"
        parts = 3 if request.param == "folder" else 1
        written = path if parts > 1 else tmp_path / "parts" / name
        spark.createDataFrame(listed, schema).repartition(parts).write.parquet(str(written))
        if parts == 1:
            shutil.copy(next(written.glob("part-*.parquet")), path)
    return str(tmp_path)


def test_stream_normalized(spark, tables):
    found = registry.stream_normalized(spark, tables)
    assert [r[0] for r in rows(found, "doc_id")] == [i for i in range(12) if i % 7 >= 4]


def test_stream_embedded(spark, tables):
    found = registry.stream_embedded(spark, tables)
    assert [(r["id"], r["n_terms"]) for r in found.orderBy("id").collect()] == [(i, 1.0 + i % 7) for i in range(12)]


def test_stream_scored(spark, tables):
    found = rows(registry.stream_scored(spark, tables), "id")
    assert [r[0] for r in found] == list(range(40))
    assert rows(registry.stream_scored_by_batch(spark, tables), "id") == found
