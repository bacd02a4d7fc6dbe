"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from textlab.llm import queries

from . import cases

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def result(spark, name):
    return sorted(contract.queries()[name](spark, FOLDER).collect())


def test_all_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "pack"]
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    relation = duck.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    assert mine == sorted(tuple(str(r[i]) for i in at) for r in relation.fetchall())


def test_personal_data(spark, texts):
    names = list(cases.BASE)
    for r in result(spark, "op1_personal_data"):
        base = cases.base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in names] == [sum(s[0] == i for s in base) for i in range(4)]
        listed = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == cases.digest(listed.encode())
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_token_records(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in result(spark, "op2_token_records")] == expected


def test_repeats(spark, texts):
    expected = [
        (doc, n, sum(b - a for a, b in spans), len(spans), cases.digest(kept))
        for doc, (n, spans, kept) in zip(texts, cases.repeats(list(texts.values()), 100))
    ]
    assert [tuple(r) for r in result(spark, "op3_repeats")] == expected


def test_packing(spark, texts):
    found = result(spark, "op4_packing")
    used = cases.fills([(r["sequence_id"], r["offset"], r["length"]) for r in found])
    assert max(used.values()) <= 1024 and sum(used.values()) > 0.98 * 1024 * len(used)
    assert {r["doc_id"] for r in found} == set(texts)


def test_near_duplicates(spark, texts):
    ids = list(texts)
    expected = [
        (doc, n, ids[c], doc == ids[c]) for doc, (n, c) in zip(ids, cases.near_components(list(texts.values()), 85, 3))
    ]
    assert [tuple(r) for r in result(spark, "op7_near_duplicates")] == expected


def test_resampling_keeps_good_documents(spark, texts):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    found = {r["doc_id"]: r["kept"] for r in result(spark, "op10_quality")}
    assert set(found) == set(texts)
    good = [found[d] for d, q in labels.items() if q == 1]
    assert sum(good) >= 0.95 * len(good)
