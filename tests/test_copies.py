"""How often a neighbour search lays out a row, whatever the size of the blocks asked for."""

import numpy as np
import pytest

from textlab.operators import knn, knn_pruned


@pytest.mark.parametrize("n", [1, 300, 20_000, 700_000])
def test_blocks_grow_with_the_table(n):
    rows = knn.grid_rows(n, 64, 128 * 1024)
    assert -(-n // rows) <= knn.COPIES
    assert rows <= knn.block_rows(knn.BLOCK_BYTES, 64)


def test_blocks_as_large_as_asked_for():
    assert knn.grid_rows(10, 64, 2 * knn.BLOCK_BYTES) == knn.block_rows(2 * knn.BLOCK_BYTES, 64)


def test_queries_go_to_bundles_and_not_to_each_cell(spark):
    vectors = np.random.default_rng(3).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id BIGINT, v ARRAY<DOUBLE>")
    pivots = knn_pruned.choose_pivots(df, "id", "v", 1500)
    located = knn_pruned.locate(df, "v", pivots).groupBy("_cell")
    table = located.agg({"*": "count", "_angle": "max"}).collect()
    known = [{"_cell": r["_cell"], "n": r["count(1)"], "low": 0.0, "high": r["max(_angle)"]} for r in table]
    cells = knn_pruned.Cells(pivots, known)
    bundle = cells.bundles(knn.grid_rows(1500, 16, 16 * 8 * 10))
    assert len(bundle) > 2 * knn.COPIES >= len(set(bundle))
    barred = df.selectExpr("id", "v", "-1D AS bar")
    sent = knn_pruned.to_bundles(barred, "id", "v", cells, bundle, 5, "bar")
    assert sent.count() == 1500 * len(set(bundle))
    assert sent.distinct().count() == sent.count()
