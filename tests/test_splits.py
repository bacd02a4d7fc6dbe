import hashlib
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from textlab.operators import ranks, sampling, splits


def corpus(spark, labels, parts=3):
    return spark.createDataFrame(list(enumerate(labels)), "id BIGINT, label STRING").repartition(parts)


def seeded(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())


@pytest.mark.parametrize(
    "sizes,expected",
    [
        ({"ai": 8, "human": 2}, {"ai": (6, 1, 1), "human": (1, 0, 1)}),
        ({"ai": 1, "human": 1}, {"ai": (1, 0, 0), "human": (0, 0, 1)}),
        ({"ai": 100}, {"ai": (70, 15, 15)}),
    ],
)
def test_quotas(sizes, expected):
    assert splits.split_quotas(sizes) == expected


@pytest.mark.parametrize("n_ai,n_human", [(341, 58), (400001, 94142), (7, 5), (1, 0), (10**12, 3)])
def test_quotas_add_up(n_ai, n_human):
    sizes = {"ai": n_ai, "human": n_human}
    total = n_ai + n_human
    found = splits.split_quotas(sizes)
    held = math.ceil(0.30 * total)
    assert sum(t for t, _, _ in found.values()) == total - held
    assert sum(t for _, _, t in found.values()) == math.ceil(0.5 * held)
    assert all(sum(found[label]) == n and min(found[label]) >= 0 for label, n in sizes.items())


def test_published_split_sizes():
    found = splits.split_quotas({"ai": 495505 - 95661, "human": 95661})
    assert [sum(part) for part in zip(*found.values())] == [346853, 74326, 74326]


@pytest.mark.parametrize("digits", [1, 4])
def test_split_takes_rows_in_seeded_order(spark, digits):
    labels = ["ai" if i % 5 else "human" for i in range(500)]
    found = dict(rows(splits.stratified_split(corpus(spark, labels), digits=digits)))
    quotas = splits.split_quotas({"ai": 400, "human": 100})
    expected = {}
    for label, (train, val, _) in quotas.items():
        order = seeded(i for i, x in enumerate(labels) if x == label)
        expected |= {i: "train" if r < train else "val" if r < train + val else "test" for r, i in enumerate(order)}
    assert found == expected


def test_split_does_not_depend_on_partitioning(spark):
    labels = ["ai" if i % 3 else "human" for i in range(300)]
    first = rows(splits.stratified_split(corpus(spark, labels, 1)))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert rows(splits.stratified_split(corpus(spark, labels, 7))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tiny_splits(spark):
    assert rows(splits.stratified_split(corpus(spark, ["ai", "human"]))) == [(0, "train"), (1, "test")]


def test_unknown_labels_have_no_split(spark):
    df = spark.createDataFrame([(0, "ai"), (1, "human"), (2, None)], "id BIGINT, label STRING")
    cuts = splits.split_cuts(df)
    more = df.unionByName(spark.createDataFrame([(3, "odd")], df.schema))
    assert rows(splits.apply_cuts(more, cuts).select("id", "split")) == [(0, "train"), (1, "test"), (2, None), (3, None)]


def test_assignment_is_a_map_without_shuffle(spark):
    df = corpus(spark, ["ai", "human"] * 50)
    cuts = splits.split_cuts(df)
    plan = splits.apply_cuts(spark.range(100).withColumn("label", F.lit("ai")), cuts)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Sort" not in text


def test_hash_rank(spark):
    df = corpus(spark, ["ai"] * 200 + ["human"] * 30)
    found = {r["id"]: r["rank"] for r in ranks.hash_rank(df, strata=["label"], seed=9, digits=1).collect()}
    for ids in (range(200), range(200, 230)):
        assert {i: r for i, r in found.items() if i in ids} == {i: r for r, i in enumerate(seeded(ids, 9), 1)}


def test_dense_ids_follow_the_sort_key(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    found = {r["k"]: r["id"] for r in ranks.dense_ids(df, order_by=["k"]).collect()}
    assert found == {k: k for k in range(1000)}


def test_dense_ids_keep_partition_order_without_a_key(spark):
    df = spark.range(0, 100, numPartitions=4).withColumnRenamed("id", "k").filter("k % 3 = 0")
    found = {r["k"]: r["id"] for r in ranks.dense_ids(df).collect()}
    assert found == {k: k // 3 for k in range(0, 100, 3)}


@pytest.mark.parametrize("labels", [["ai"] * 40 + ["human"] * 9, ["ai"] * 3 + ["human"] * 20, ["ai", "human"] * 6])
def test_undersample(spark, labels):
    df = corpus(spark, labels).withColumn("extra", F.lit(1))
    kept = sampling.undersample(df)
    assert kept.columns == df.columns
    smaller = min(labels.count("ai"), labels.count("human"))
    expected = []
    for label in ("ai", "human"):
        expected += seeded(i for i, x in enumerate(labels) if x == label)[:smaller]
    assert sorted(r["id"] for r in kept.collect()) == sorted(expected)


def test_undersample_needs_both_classes(spark):
    with pytest.raises(ValueError, match="empty"):
        sampling.undersample(corpus(spark, ["ai", "ai"]))


def test_nested_samples(spark):
    found = rows(sampling.nested_samples(corpus(spark, ["ai"] * 50), [5, 20, 400, 0]))
    order = seeded(range(50))
    by_size = {n: {i for size, i in found if size == n} for n in (0, 5, 20, 400)}
    assert by_size == {0: set(), 5: set(order[:5]), 20: set(order[:20]), 400: set(order)}


def text_corpus(spark):
    return spark.createDataFrame(
        [
            (0, "w " * 99, "human", "human", "reddit", "test"),
            (1, "w " * 100, "ai", "gpt", "reddit", "test"),
            (2, "w", "ai", "chatgpt", "qa_forum", "train"),
            (3, "w", "ai", "gpt", "qa_forum", "val"),
            (4, "w", "ai", None, None, "train"),
            (5, "w", "ai", "chatgpt", "reddit", "test"),
        ],
        "id BIGINT, text STRING, label STRING, source_model STRING, platform STRING, split STRING",
    )


def test_scenarios(spark):
    adversarial = spark.createDataFrame([(0, "ai"), (1, "human")], "id BIGINT, label STRING")
    found = rows(splits.scenarios(text_corpus(spark), adversarial).select("scenario", "id"))
    assert found == [
        ("adversarial_raid", 0), ("adversarial_raid", 1),
        ("cross_model_chatgpt", 2), ("cross_model_chatgpt", 5),
        ("cross_platform_qa_forum", 2), ("cross_platform_qa_forum", 3),
        ("short_text", 0), ("short_text", 5),
        ("standard", 0), ("standard", 1), ("standard", 5),
    ]


def test_holdout_and_reduced_splits(spark):
    df = text_corpus(spark)
    assert rows(splits.holdout_test(df, "source_model", "chatgpt")) == [(2,), (5,)]
    assert rows(splits.holdout_splits(df, "source_model", "chatgpt")) == [(3, "val"), (4, "train")]
    assert rows(splits.reduced_splits(df)) == [
        ("cross_model_chatgpt", 3, "val"), ("cross_model_chatgpt", 4, "train"),
        ("cross_platform_qa_forum", 4, "train"),
    ]


def test_unmatched_rows_have_no_split(spark):
    known = spark.createDataFrame([(0, "train")], "id BIGINT, split STRING")
    assert rows(splits.with_split(spark.range(2), known)) == [(0, "train"), (1, None)]
