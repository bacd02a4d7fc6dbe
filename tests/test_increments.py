import pytest
from conftest import rows
from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.operators.increments import GrowingIds, GrowingMetrics, GrowingSplit
from textlab.operators.splits import assign_split
from textlab.storage import Batches, scratch_path
from textlab.streaming import streams


def labelled(spark, n, first=0):
    listed = [(first + i, "ai" if i % 5 else "human" if i % 2 else None) for i in range(n)]
    return spark.createDataFrame(listed, "id BIGINT, label STRING")


@pytest.mark.parametrize("digits", [1, 4])
def test_split_of_increments_is_the_split_of_the_union(spark, digits):
    parts = [labelled(spark, n, first) for n, first in ((130, 0), (7, 200), (300, 1000), (0, 5000))]
    growing = GrowingSplit(spark, scratch_path(spark, "split"), digits=digits)
    union = None
    for i, part in enumerate(parts):
        growing.add(part, f"p{i}")
        growing.add(part, f"p{i}")
        union = part if union is None else union.unionByName(part)
        assert rows(growing.assign(union)) == rows(assign_split(union))
    # Another process goes on from the folder.
    again = GrowingSplit(spark, growing._store.path, digits=digits)
    again.add(labelled(spark, 40, 9000), "late")
    union = union.unionByName(labelled(spark, 40, 9000))
    assert rows(again.assign(union)) == rows(assign_split(union))


def test_a_cut_reads_only_its_prefixes(spark):
    growing = GrowingSplit(spark, scratch_path(spark, "split"))
    growing.add(labelled(spark, 100), "a")
    found = growing._store.read("keys", "label STRING, _key STRUCT<h: STRING, id: STRING>, _prefix STRING")
    plan = found.filter(F.col("_prefix").isin(["00ab", "7fff"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(_prefix, [00ab,7fff])" in plan.split("PushedFilters")[1]


def test_ids_go_on(spark):
    listed = [("b", 3), ("a", 1), ("c", 2)]
    growing = GrowingIds(spark, scratch_path(spark, "ids"))
    schema = "id BIGINT, name STRING, place INT"
    growing.add(spark.createDataFrame(listed, "name STRING, place INT"), "x", ["place"])
    growing.add(spark.createDataFrame([], "name STRING, place INT"), "nothing", ["place"])
    growing.add(spark.createDataFrame([("e", 5), ("d", 4)], "name STRING, place INT"), "y", ["place"])
    growing.add(spark.createDataFrame([("e", 5), ("d", 4)], "name STRING, place INT"), "y", ["place"])
    assert rows(growing.rows(schema)) == [(0, "a", 1), (1, "c", 2), (2, "b", 3), (3, "d", 4), (4, "e", 5)]
    assert rows(growing.rows(schema, ["y"])) == [(3, "d", 4), (4, "e", 5)]


def test_a_batch_that_failed_half_way_is_written_over(spark):
    growing = GrowingIds(spark, scratch_path(spark, "ids"))
    spark.range(7).write.parquet(growing._store.folder("rows", "x"))
    assert growing.rows("id BIGINT").count() == 0
    growing.add(spark.range(3).select(F.col("id").alias("v")), "x", ["v"])
    assert rows(growing.rows("id BIGINT, v BIGINT")) == [(0, 0), (1, 1), (2, 2)]


def test_nothing_yet(spark):
    store = Batches(spark, scratch_path(spark, "none"), "n BIGINT")
    assert store.log() == [] and store.read("t", "a INT").count() == 0
    assert GrowingMetrics(spark, scratch_path(spark, "none")).by_source().collect() == []
    split = GrowingSplit(spark, scratch_path(spark, "none")).assign(labelled(spark, 3))
    assert {r["split"] for r in split.collect()} == {None}


def predictions(spark, n=400):
    listed = [
        (i, "ai" if i % 3 else "human", "ai" if i % 4 else "human", (i * 7 % 50) / 50, [None, "g1", "g2"][i % 3])
        for i in range(n)
    ]
    return spark.createDataFrame(
        listed, "id BIGINT, label STRING, prediction STRING, confidence DOUBLE, source_model STRING"
    )


def test_metrics_of_a_stream_equal_the_batch(spark, tmp_path):
    found = predictions(spark)
    found.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = GrowingMetrics(spark, str(tmp_path / "state"))
    streams.stream_metrics(arriving, state, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(line["batch"] for line in state._store.log()) == ["0", "1", "2", "3"]
    assert rows(state.by_source()) == rows(M.metrics_by_source(found))
    assert rows(state.overall()) == rows(M.metrics(found))
    assert state.overall(["0", "1"]).first()["n_records"] == sum(
        line["n"] for line in state._store.log() if line["batch"] in "01"
    )


def test_streams_into_split_and_ids(spark, tmp_path):
    corpus = labelled(spark, 90)
    corpus.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    split = GrowingSplit(spark, str(tmp_path / "split"))
    streams.stream_split(source(), split, str(tmp_path / "c1")).awaitTermination()
    assert rows(split.assign(corpus)) == rows(assign_split(corpus))
    ids = GrowingIds(spark, str(tmp_path / "ids"), id_col="number")
    streams.stream_ids(source(), ids, str(tmp_path / "c2"), order_by=["id"]).awaitTermination()
    numbered = ids.rows("number BIGINT, id BIGINT, label STRING").collect()
    assert sorted(r["number"] for r in numbered) == list(range(90)) and {r["id"] for r in numbered} == set(range(90))
