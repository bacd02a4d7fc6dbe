"""The block form stores each side once and reads candidates block by block."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from textlab.operators import embed, knn


def table(spark, n, seed, dims=4):
    draw = random.Random(seed)
    rows = [(i * 3 + seed, [float(draw.randrange(-2, 3)) for _ in range(dims)], f"l{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, embedding ARRAY<FLOAT>, label STRING")


def rows_of(found):
    return sorted(map(tuple, found.collect()))


def forms(spark, queries, train, monkeypatch, **options):
    stored = rows_of(knn.knn_join(queries, train, 4, strategy="block", **options))
    monkeypatch.setattr(knn, "_reachable", lambda spark: False)
    grid = rows_of(knn.knn_join(queries, train, 4, strategy="block", **options))
    options.pop("block_bytes", None)
    return stored, grid, rows_of(knn.knn_join(queries, train, 4, strategy="broadcast", **options))


@pytest.mark.parametrize("block_bytes", [32 * 7, 32 * 40, 32 * 1000])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_stored_blocks_give_the_rows_of_the_other_forms(spark, monkeypatch, block_bytes, exclude_self):
    monkeypatch.setattr(knn, "COPIES", 1000)
    queries, train = table(spark, 90, 0).repartition(5), table(spark, 130, 0).repartition(3)
    options = {"block_bytes": block_bytes, "exclude_self": exclude_self, "carry": ["label"]}
    stored, grid, shipped = forms(spark, queries, train, monkeypatch, **options)
    assert stored == grid == shipped and len(stored) == 90 * 4


def test_blocks_with_fewer_candidates_than_wanted(spark, monkeypatch):
    monkeypatch.setattr(knn, "COPIES", 1000)
    stored, grid, shipped = forms(spark, table(spark, 20, 1), table(spark, 9, 2), monkeypatch, block_bytes=32 * 2)
    assert stored == grid == shipped and len(stored) == 20 * 4


def test_nothing_to_search(spark, monkeypatch):
    monkeypatch.setattr(knn, "COPIES", 1000)
    some, none = table(spark, 5, 0), table(spark, 5, 0).filter("id < 0")
    assert knn.knn_join(some, none, 3, strategy="block", block_bytes=64).collect() == []
    assert knn.knn_join(none, some, 3, strategy="block", block_bytes=64).collect() == []


def test_carried_columns_keep_their_types(spark, monkeypatch):
    monkeypatch.setattr(knn, "COPIES", 1000)
    kinds = {"at": "TIMESTAMP", "day": "DATE", "n": "DECIMAL(10,2)", "few": "SMALLINT", "raw": "BINARY", "list": "ARRAY<INT>"}
    values = (datetime.datetime(2020, 1, 2, 3, 4, 5, 678901), datetime.date(2020, 2, 3), None, 7, bytearray(b"ab"), [1, 2])
    rows = [(i, [1.0, float(i)], *values) for i in range(6)]
    train = spark.createDataFrame(rows, "id BIGINT, embedding ARRAY<FLOAT>, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))
    options = {"carry": list(kinds), "block_bytes": 32}
    found = {s: rows_of(knn.knn_join(train, train, 2, strategy=s, **options)) for s in ("block", "broadcast")}
    assert found["block"] == found["broadcast"] and found["block"][0][3:-1] == values


def test_no_row_is_copied_in_a_shuffle(spark, monkeypatch):
    """Rows were laid out once for each block of the other side."""
    monkeypatch.setattr(knn, "COPIES", 1000)
    exploded = []
    plain = F.explode
    monkeypatch.setattr(knn.F, "explode", lambda *a: exploded.append(a) or plain(*a))
    found = knn.knn_join(table(spark, 60, 0), table(spark, 60, 0), 3, strategy="block", block_bytes=32 * 5)
    assert found.count() == 180 and not exploded
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_a_new_store_shuffles_no_text(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(i, f"word{i} a b") for i in range(30)], "id BIGINT, text STRING")
    plans = []
    plain = embed._append
    monkeypatch.setattr(embed, "_append", lambda part, *a: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or plain(part, *a))
    store = str(tmp_path / "store")
    assert embed.embed_missing(corpus, store, embed.HashingEmbedder(8)).count() == 30
    assert embed.embed_missing(corpus, store, embed.HashingEmbedder(8)).count() == 30
    assert "Join" not in plans[0] and "Join" in plans[1]
