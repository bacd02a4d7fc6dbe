import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from textlab.functions.vectors import cosine, dot, l2_normalize
from textlab.operators import checks, knn, splits


def table(spark, vectors, ids=None, kind="FLOAT", **extra):
    ids = list(range(len(vectors))) if ids is None else ids
    data = [(int(i), [float(x) for x in v], *[c[n] for c in extra.values()]) for n, (i, v) in enumerate(zip(ids, vectors))]
    columns = "".join(f", {name} STRING" for name in extra)
    return spark.createDataFrame(data, f"id BIGINT, embedding ARRAY<{kind}>{columns}").repartition(3)


def brute(queries, candidates, k, exclude_self=False):
    """``{qid: [tid, ...]}`` by plain sorting; ids are positions."""

    def unit(m):
        m = np.asarray(m, dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = (unit(queries)[:, None, :] * unit(candidates)[None, :, :]).sum(axis=2)
    result = {}
    for q, line in enumerate(scores):
        order = sorted(range(len(line)), key=lambda t: (-line[t], t))
        result[q] = [t for t in order if not (exclude_self and t == q)][:k]
    return result


def found(df):
    by_query = {}
    for r in df.orderBy("qid", "rank").collect():
        hits = by_query.setdefault(r["qid"], [])
        hits.append(r["tid"])
        assert r["rank"] == len(hits)
    return by_query


STRATEGIES = [
    {"strategy": "broadcast"},
    {"strategy": "block"},
    {"strategy": "block", "block_bytes": 8 * 8 * 20},
    {"broadcast_bytes": 0, "block_bytes": 8 * 8 * 7},
    {"strategy": "pruned"},
    {"strategy": "pruned", "block_bytes": 8 * 8 * 20},
]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8)).astype(np.float32) * rng.integers(1, 4, size=(120, 1))
    m[10] = m[90]  # copies under other ids
    m[11] = m[90]
    m[50] = 0  # no direction
    return m


@pytest.mark.parametrize("options", STRATEGIES)
@pytest.mark.parametrize("exclude_self", [False, True])
def test_same_rows_as_brute_force(spark, points, options, exclude_self):
    df = table(spark, points)
    result = knn.knn_join(df, df, 6, exclude_self=exclude_self, **options)
    assert found(result) == brute(points, points, 6, exclude_self)


def test_zero_vector_scores_zero(spark, points):
    result = knn.knn_join(table(spark, points[50:51]), table(spark, points), 3)
    assert rows(result, "qid", "rank") == [(0, 1, 0, 0.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0)]


@pytest.mark.parametrize("options", STRATEGIES)
def test_fewer_candidates_than_k(spark, points, options):
    result = knn.knn_join(table(spark, points[:5]), table(spark, points[:4]), 10, exclude_self=True, **options)
    assert {q: len(t) for q, t in found(result).items()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 4}


@pytest.mark.parametrize("options", STRATEGIES)
def test_no_candidates_or_queries(spark, points, options):
    some, none = table(spark, points[:5]), table(spark, points[:5]).filter("id < 0")
    assert knn.knn_join(some, none, 3, **options).count() == 0
    assert knn.knn_join(none, some, 3, **options).count() == 0


@pytest.mark.parametrize("options", STRATEGIES)
def test_a_third_of_all_candidates_are_copies(spark, options):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 8))
    m[100:200] = m[7]
    df = table(spark, m, kind="DOUBLE")
    for exclude_self in (False, True):
        result = knn.knn_join(df, df, 4, exclude_self=exclude_self, **options)
        assert found(result) == brute(m, m, 4, exclude_self)


def test_near_ties_are_decided_in_double_precision(spark):
    base = np.ones(8)
    m = np.array([base + np.eye(8)[i % 8] * 1e-9 * (i + 1) for i in range(40)])
    df, q = table(spark, m, kind="DOUBLE"), table(spark, [np.arange(1.0, 9.0)], kind="DOUBLE")
    expected = brute([np.arange(1.0, 9.0)], m, 5)
    for options in STRATEGIES:
        assert found(knn.knn_join(q, df, 5, **options)) == expected


def test_small_work_areas_do_not_change_the_result(spark, points, monkeypatch):
    ids = np.arange(len(points))
    whole = list(knn.Candidates(ids, points.astype(float), 6).search(ids, points.astype(float), 6, True))
    monkeypatch.setattr(knn, "SCORE_BYTES", 4 * 120 * 5)
    monkeypatch.setattr(knn, "RESCORE_BYTES", 8 * 8 * 3)
    parts = list(knn.Candidates(ids, points.astype(float), 6).search(ids, points.astype(float), 6, True))
    assert len(parts) > len(whole)
    for a, b in zip(zip(*whole), zip(*parts)):
        assert np.array_equal(np.concatenate(a), np.concatenate(b))


@pytest.mark.parametrize("options", STRATEGIES)
def test_candidate_columns_come_along(spark, points, options):
    labels = ["ai" if i % 2 else None for i in range(len(points))]
    df = table(spark, points, label=labels)
    for r in knn.knn_join(df, df, 4, carry=["label"], **options).collect():
        assert r["label"] == labels[r["tid"]]


def test_held_out_rows_are_never_candidates(spark, points):
    df = splits.assign_split(table(spark, points, label=["ai", "human"] * 60))
    split = {r["id"]: r["split"] for r in df.collect()}
    result = knn.knn_join(df, splits.in_split(df, "train"), 5, exclude_self=True).collect()
    assert result and all(split[r["tid"]] == "train" and r["tid"] != r["qid"] for r in result)


def test_broadcast_falls_back_for_what_is_too_large(spark, points):
    df = table(spark, points)
    small = knn.knn_join(df, df, 3, strategy="broadcast", broadcast_bytes=100)
    assert "CoGroups" in small._jdf.queryExecution().toString()
    assert sorted(small.collect()) == sorted(knn.knn_join(df, df, 3, strategy="block").collect())
    with pytest.raises(ValueError, match="strategy"):
        knn.knn_join(df, df, 3, strategy="guess")


def test_block_plan_keeps_only_top_k_before_the_merge(spark, points):
    df = table(spark, points)
    plan = knn.knn_join(df, df, 3, strategy="block")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bad", [[None, [1.0, 2.0]], [[1.0], [1.0, 2.0]], [[float("nan"), 1.0], [1.0, 2.0]]])
def test_broken_vectors_are_an_error(spark, bad):
    df = spark.createDataFrame(list(enumerate(bad)), "id BIGINT, embedding ARRAY<DOUBLE>").coalesce(1)
    with pytest.raises(Exception, match="vectors"):
        knn.knn_join(df, df, 1).collect()


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = df.select(dot(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("b")), l2_normalize(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(24.0, 0.96, [0.6, 0.8]), (0.0, 0.0, [0.0, 0.0])]


def test_neighbour_payload(spark):
    neighbours = spark.createDataFrame([(1, 2, 1), (3, 2, 1)], "qid BIGINT, tid BIGINT, rank INT")
    texts = spark.createDataFrame([(2, "two")], "id BIGINT, text STRING")
    got = knn.neighbour_payload(neighbours, texts, {"text": F.col("text")})
    assert rows(got.select("qid", "tid", "text")) == [(1, 2, "two"), (3, 2, "two")]


def test_self_match_check(spark, points):
    clean = np.delete(points, [10, 11, 50], axis=0)
    assert checks.check_self_match(table(spark, clean)).first().asDict() == {
        "n_rows": 117, "n_self": 117, "share": 1.0, "ok": True,
    }
    found = checks.check_self_match(table(spark, points)).first()
    assert (found["n_rows"], found["n_self"], found["ok"]) == (120, 117, False)


def clusters(n, groups, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, 8)) * 5
    # Two thirds of all rows lie in two of the groups.
    group = np.where(rng.random(n) < 0.66, rng.integers(0, 2, n), rng.integers(0, groups, n))
    return centers[group] + rng.normal(size=(n, 8)) * 0.05


def test_pruning_skips_cells_and_loses_nothing(spark, monkeypatch):
    from textlab.operators import knn_pruned

    m = clusters(900, 12, 5)
    df = table(spark, m, kind="DOUBLE")
    routed = []
    real = knn_pruned.route

    def spy(*args):
        routed.append(real(*args))
        return routed[-1]

    monkeypatch.setattr(knn_pruned, "route", spy)
    result = knn.knn_join(df, df, 5, exclude_self=True, strategy="pruned", block_bytes=8 * 8 * 50)
    assert found(result) == brute(m, m, 5, True)
    located = knn_pruned.locate(df, "embedding", knn_pruned.choose_pivots(df, "id", "embedding", 900))
    held = {r["_cell"]: r["count"] for r in located.groupBy("_cell").count().collect()}
    pairs = sum(held[r["_cell"]] for part in routed for r in part.select("_cell").collect())
    assert pairs < 0.5 * 900 * 900


def test_pruned_bounds_hold(spark):
    from textlab.operators.knn_pruned import Cells

    rng = np.random.default_rng(6)
    unit = rng.normal(size=(400, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    pivots, queries = unit[:10], unit[350:]
    angles = np.arccos(np.clip(unit[:350] @ pivots.T, -1, 1))
    cell = angles.argmin(axis=1)
    table = [
        {"_cell": c, "n": int((cell == c).sum()), "low": angles[cell == c, c].min(), "high": angles[cell == c, c].max()}
        for c in range(10)
    ]
    bounds = Cells(pivots, table).bounds(queries)
    for c in range(10):
        assert ((queries @ unit[:350][cell == c].T).max(axis=1) <= bounds[:, c] + 1e-9).all()
