import pytest
from conftest import rows

from textlab.operators import classify, prompts
from textlab.plans import evaluation, training


def votes(spark, data):
    return spark.createDataFrame(
        data, "qid BIGINT, tid BIGINT, score DOUBLE, label STRING, source_model STRING, rank INT"
    )


@pytest.fixture(scope="module")
def neighbours(spark):
    return votes(
        spark,
        [
            (1, 10, 0.9, "ai", "gpt", 1), (1, 11, 0.8, "human", "human", 2),
            (2, 10, 0.9, "human", "human", 1), (2, 12, 0.7, "human", "human", 2), (2, 13, 0.6, "ai", "gpt", 3),
            (3, 14, 0.5, "ai", None, 1), (3, 15, 0.4, "ai", "b", 2), (3, 16, 0.3, "ai", "a", 3),
        ],
    )


def test_vote_ties_and_missing_neighbours_go_to_ai(spark, neighbours):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id BIGINT")
    assert rows(classify.knn_vote(queries, neighbours)) == [
        (1, 1, 2, "ai", 0.5), (2, 1, 3, "human", 1 / 3), (3, 3, 3, "ai", 1.0), (4, 0, 0, "ai", 0.5),
    ]


def test_evidence_is_in_rank_order(spark, neighbours):
    got = classify.knn_evidence(neighbours.orderBy("score")).filter("qid = 2").first()
    assert got["verdict"] == "Human-written"
    assert got["summary"] == "3 similar texts found, 1 were AI-generated"
    assert [tuple(e) for e in got["evidence"]] == [
        (1, 10, 0.9, "human"), (2, 12, 0.7, "human"), (3, 13, 0.6, "ai"),
    ]


def test_attribution_ties_by_name(spark, neighbours):
    assert rows(classify.knn_attribution(neighbours)) == [(1, "gpt", 1), (2, "human", 2), (3, "a", 1)]


def test_random_baseline(spark):
    df = spark.range(4000)
    first, again = (rows(classify.random_baseline(d)) for d in (df, df.repartition(7)))
    assert first == again
    for _, verdict, confidence in first:
        assert 0.3 <= confidence <= 0.7 and verdict in ("ai", "human")
    assert 0.45 < sum(v == "ai" for _, v, _ in first) / 4000 < 0.55


def test_batch_predictor(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id BIGINT, text STRING")
    seen = classify.batch_predictor(
        lambda texts: [{"prediction": "ai" if len(texts) <= 7 else "human", "confidence": len(t)} for t in texts], 7
    )
    assert rows(seen(df)) == [(i, "ai", float(i)) for i in range(50)]


def test_predictor_with_wrong_number_of_answers_fails(spark):
    df = spark.createDataFrame([(1, "x")], "id BIGINT, text STRING")
    with pytest.raises(Exception, match="0 answers for 1 texts"):
        classify.batch_predictor(lambda texts: [])(df).collect()


def test_predictions_must_match_records(spark):
    records = spark.createDataFrame(
        [(1, "x", "ai", "m"), (2, "y", "human", "human")], "id BIGINT, text STRING, label STRING, source_model STRING"
    )
    with pytest.raises(ValueError, match="n_missing"):
        evaluation.evaluate(lambda df: classify.random_baseline(df).filter("id = 1"), records)


HEADER = (
    "You are a classifier that determines whether a social media post was written by a human or generated by AI.\n\n"
)


def test_prompts(spark):
    corpus = spark.createDataFrame(
        [
            (1, "first", "ai", "train"), (2, "b" * 300, "human", "train"), (3, "c" * 301, "ai", "val"),
            (4, "lonely", "human", "test"),
        ],
        "id BIGINT, text STRING, label STRING, split STRING",
    )
    found = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 6), (2, 1, 1)], "qid BIGINT, tid BIGINT, rank INT")
    got = {(r["id"], r["variant"]): r for r in prompts.instruction_records(corpus, found, corpus).collect()}
    assert len(got) == 8
    assert got[1, "with_rag"]["instruction"] == (
        HEADER + "Here are some similar texts and their labels for reference:\n\n"
        f"Example 1 (label: human):\n{'b' * 300}\n\nExample 2 (label: ai):\n{'c' * 300}...\n\n"
        "Now classify the following post as either 'ai' or 'human'.\n\nPost: first"
    )
    assert got[4, "with_rag"]["instruction"] == (
        HEADER + "Here are some similar texts and their labels for reference:\n\n\n\n"
        "Now classify the following post as either 'ai' or 'human'.\n\nPost: lonely"
    )
    assert got[3, "without_rag"]["instruction"] == (
        HEADER + f"Classify the following post as either 'ai' or 'human'.\n\nPost: {'c' * 301}"
    )
    assert got[3, "without_rag"]["output"] == "ai" and got[3, "without_rag"]["split"] == "val"
    assert {r["instruction"] for r in prompts.rag_prompts(corpus, found, corpus).collect()} == {
        r["instruction"] for (_, variant), r in got.items() if variant == "with_rag"
    }


def test_training_records(spark):
    corpus = spark.createDataFrame(
        [(i, f"text {i}", "human" if i % 4 == 0 else "ai", ("train", "train", "val", "test")[i // 2 % 4]) for i in range(40)],
        "id BIGINT, text STRING, label STRING, split STRING",
    )
    vectors = spark.createDataFrame(
        [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id BIGINT, embedding ARRAY<FLOAT>"
    )
    everything = training.training_records(corpus, vectors)
    assert everything.count() == 80
    with pytest.raises(ValueError, match="40 corpus rows met 39 vectors"):
        training.training_records(corpus, vectors.filter("id <> 7"))
    balanced = training.training_records(corpus, vectors, balanced=True)
    counts = rows(balanced.filter("split = 'train'").groupBy("variant", "output").count())
    assert [n for *_, n in counts] == [5, 5, 5, 5]
    kept = {r["id"] for r in balanced.filter("split = 'train'").collect()}
    shown = {
        int(line.removeprefix("text "))
        for r in balanced.filter("variant = 'with_rag'").collect()
        for line in r["instruction"].split("\n")
        if line.startswith("text ")
    }
    assert shown <= kept
    assert balanced.filter("split <> 'train'").count() == everything.filter("split <> 'train'").count()
