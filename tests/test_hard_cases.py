"""Cases in which rows used to get lost or guards used to pass."""

import pytest

from conftest import rows
from textlab.operators import classify, metrics, ranks, sampling
from textlab.operators.knn import knn_join
from textlab.plans.training import labelled_vectors
from textlab.sources.readers import read_csv_folder
from textlab.streaming import streams


def test_stream_score_survives_a_growing_candidate_table(spark, tmp_path):
    schema = "id BIGINT, embedding ARRAY<FLOAT>"
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    small = [(1, "ai", [1.0, 0.0]), (2, "human", [0.0, 1.0])]
    for name, ids, train in (("a", range(5), small), ("b", range(5, 10), small * 1 + [(i, "ai", [1.0, 0.1]) for i in range(3, 40)])):
        lines = "".join(f'{{"id": {i}, "embedding": [1.0, {i}.0]}}\n' for i in ids)
        (source / f"{name}.json").write_text(lines)
        table = spark.createDataFrame(train, "id BIGINT, label STRING, embedding ARRAY<FLOAT>")
        arriving = spark.readStream.schema(schema).json(str(source))
        streams.stream_score(arriving, table, out, state, k=1, broadcast_bytes=64).awaitTermination()
    found = spark.read.parquet(out)
    assert sorted(r["id"] for r in found.collect()) == list(range(10))
    assert set(found.columns) == {"id", "ai_votes", "total_votes", "prediction", "confidence", "batch_id"}


def test_null_groups_stay_in_metrics(spark):
    data = [(i, "ai" if i % 3 else "human", "ai" if i % 2 else "human", i / 40, g) for i in range(40) for g in ("val", None)]
    df = spark.createDataFrame(data, "id BIGINT, label STRING, prediction STRING, confidence DOUBLE, g STRING")
    assert rows(metrics.roc_curve(df, ["g"], small=0)) == rows(metrics.roc_curve(df, ["g"]))
    assert {r["g"] for r in metrics.roc_curve(df, ["g"], small=0).collect()} == {"val", None}


def test_missing_confidence_is_an_error(spark):
    df = spark.createDataFrame([(1, "ai", "ai", None)], "id BIGINT, label STRING, prediction STRING, confidence DOUBLE")
    with pytest.raises(Exception, match="no confidence"):
        metrics.score_histogram(df).collect()


def test_queries_without_neighbours_keep_a_row(spark):
    queries = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    found = spark.createDataFrame([(1, 7, 0.5, "human", "m", 1)], "qid BIGINT, tid BIGINT, score DOUBLE, label STRING, source_model STRING, rank INT")
    evidence = {r["qid"]: r for r in classify.knn_evidence(found, queries=queries).collect()}
    assert (evidence[2]["verdict"], evidence[2]["confidence"], evidence[2]["evidence"]) == ("AI-generated", 0.5, [])
    assert evidence[1]["verdict"] == "Human-written" and len(evidence[1]["evidence"]) == 1
    assert rows(classify.knn_attribution(found, queries=queries)) == [(1, "m", 1), (2, None, 0)]


def test_guard_sees_ids_with_two_vectors(spark):
    corpus = spark.createDataFrame([(1, "ai", "train"), (2, "ai", "train")], "id BIGINT, label STRING, split STRING")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [0.5])], "id BIGINT, embedding ARRAY<FLOAT>")
    with pytest.raises(ValueError, match="of 1 ids"):
        labelled_vectors(corpus, vectors)


def test_null_stratum_is_ranked(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id BIGINT, s STRING")
    assert sorted((str(r["s"]), r["rank"]) for r in ranks.hash_rank(df, strata=["s"], seed=1).collect()) == [("None", 1), ("None", 2), ("a", 1)]


def test_samples_of_nothing(spark):
    assert sampling.nested_samples(spark.createDataFrame([], "id BIGINT"), [5, 10]).collect() == []


def test_broadcast_counts_carried_columns_and_falls_back(spark):
    train = spark.createDataFrame([(i, "x" * 1000, [1.0, float(i)]) for i in range(20)], "id BIGINT, name STRING, embedding ARRAY<FLOAT>")
    queries = train.select("id", "embedding")
    grid = knn_join(queries, train, 3, carry=["name"], strategy="block")
    for limit in (0, 20 * 2 * 8 + 100):
        found = knn_join(queries, train, 3, carry=["name"], strategy="broadcast", broadcast_bytes=limit)
        assert "CoGroups" in found._jdf.queryExecution().toString() and rows(found) == rows(grid)


def test_csv_names_and_headers(spark, tmp_path):
    for name in ("a b.csv", "a[1].csv", "a%20c.csv", "a*{x}.csv"):
        (tmp_path / name).write_text(f"Text,text,class\nfirst of {name},second,ai\n")
    (table,) = read_csv_folder(spark, str(tmp_path))
    assert table.columns[:3] == ["Text", "text__2", "class"]
    assert sorted(r["Text"] for r in table.collect()) == sorted(f"first of {n}" for n in ("a b.csv", "a[1].csv", "a%20c.csv", "a*{x}.csv"))
