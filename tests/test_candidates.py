import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators.candidates import CandidateStore, prepared
from textlab.operators.knn import knn_join
from textlab.storage import scratch_path

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(6, 8)) * 5


def vectors(spark, n, first=0):
    """Clustered vectors with copies, zero vectors and a third in one cluster."""
    rows = []
    for i in range(n):
        v = CENTRES[0 if i % 3 == 0 else i % 6] + RNG.normal(size=8) * 0.4
        if i % 17 == 0:
            v = np.zeros(8)
        if i % 10 == 1:
            v = CENTRES[1]
        rows.append((first + i, [float(x) for x in v], "ai" if i % 2 else "human", f"g{i % 4}"))
    schema = "id BIGINT, embedding ARRAY<DOUBLE>, label STRING, source_model STRING"
    return spark.createDataFrame(rows, schema).repartition(3)


def found(df, *extra):
    return sorted((r["qid"], r["rank"], r["tid"], round(r["score"], 9), *[r[c] for c in extra]) for r in df.collect())


@pytest.mark.parametrize("ship", [64 << 20, 0])
@pytest.mark.parametrize("self_excluded", [False, True])
def test_search_append_search(spark, ship, self_excluded):
    train, late, queries = vectors(spark, 150).cache(), vectors(spark, 60, 1000).cache(), vectors(spark, 40, 100).cache()
    store = CandidateStore.create(train, scratch_path(spark, "store"), carry=["label"])
    options = {"exclude_self": self_excluded}
    search = {"ship_bytes": ship, "block_bytes": 2048, **options}
    assert found(store.search(queries, 4, **search), "label") == found(
        knn_join(queries, train, 4, carry=["label"], strategy="block", **options), "label"
    )
    store.append(late, "late")
    store.append(late, "late")
    again = CandidateStore(spark, store.path)
    assert again.batches() == ["0", "late"] and again.rows().count() == 210
    everything = train.unionByName(late)
    assert found(again.search(queries, 4, **search), "label") == found(
        knn_join(queries, everything, 4, carry=["label"], strategy="block", **options), "label"
    )


def test_what_a_failed_append_leaves_is_not_seen(spark):
    train, late = vectors(spark, 50), vectors(spark, 20, 500)
    store = CandidateStore.create(train, scratch_path(spark, "store"))
    # Files without their lines in the cell table: an append that did not come to its end.
    late.select("id", "embedding").withColumn("angle", F.lit(0.0)).withColumn("cell", F.lit(0)).write.partitionBy(
        "cell"
    ).parquet(f"{store.path}/rows/batch=late")
    assert store.rows().count() == 50
    store.append(late, "late")
    assert store.rows().count() == 70


def test_only_asked_cells_are_read_and_no_candidate_is_shuffled(spark):
    train = vectors(spark, 200)
    store = CandidateStore.create(train, scratch_path(spark, "store"))
    plan = store.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    pruned = lambda plan: "cell" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert pruned(plan) and "Exchange" not in plan
    routed = train.limit(5).select("id", "embedding", F.lit(1).alias("_cell"))
    plan = store._shipped(routed, [1], 3, "id", "embedding", False)._jdf.queryExecution().executedPlan().toString()
    assert pruned(plan) and "Exchange" not in plan


def test_few_candidates_and_no_queries(spark):
    train, queries = vectors(spark, 3), vectors(spark, 5, 10)
    store = CandidateStore.create(train, scratch_path(spark, "store"))
    assert found(store.search(queries, 10)) == found(knn_join(queries, train, 10))
    assert store.search(queries.limit(0), 10).collect() == []
    with pytest.raises(ValueError, match="not zero"):
        CandidateStore.create(train.limit(0), scratch_path(spark, "store"))


def test_prepared_searches_agree(spark):
    train, queries = vectors(spark, 120).cache(), vectors(spark, 30, 300).cache()
    wanted = found(knn_join(queries, train, 5, carry=["label"]), "label")
    store = CandidateStore.create(train, scratch_path(spark, "store"), carry=["label"])
    for search in (
        prepared(train, 5, carry=["label"]),
        prepared(train, 5, carry=["label"], broadcast_bytes=0),
        prepared(store, 5),
    ):
        assert found(search(queries), "label") == wanted
