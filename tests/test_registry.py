"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from textlab.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "embeddings", "conversations", "pages", "benchmark")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(row):
    return tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in row)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    relation = duck.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [list(relation.columns).index(c) for c in columns]
    mine = [comparable(r[c] for c in columns) for r in df.collect()]
    theirs = [comparable(r[i] for i in at) for r in relation.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)


def test_entry(spark):
    found = contract.entry(spark)
    assert {r["split"] for r in found.collect()} == {"val", "test"}
