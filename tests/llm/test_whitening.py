"""Whitening against numpy's eigenvectors of the exact covariance."""

import numpy as np
import pytest

from textlab.llm import whitening as W


def table(spark, vectors, ids=None):
    schema = "vec_id bigint, embedding array<float>, component string, n int, _v int"
    rows = [(i if ids is None else ids[i], v, "c", 1, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, schema)


def expected(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    t = n * x - sums
    values, axes = np.linalg.eigh((t / n).T @ (t / n) / n)
    order = np.argsort(-values)
    return x, t, values[order], axes[:, order]


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    good = (rng.normal(size=(900, 6)) @ np.diag([9, 7, 5, 3, 2, 1]) + 4).tolist()
    good += [good[0]] * 300  # copies are rows of their own
    bad = [None, [1.0] * 5 + [None], [float("nan")] * 6, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]]
    mixed = good[:600] + bad + good[600:]
    ids = [i if i % 11 else None for i in range(len(mixed))]
    found = W.whiten(table(spark, mixed, ids).repartition(5), components=4).collect()
    x, t, values, axes = expected(good)
    assert len(found) == 4 * len(good) and {r["component"] for r in found} == {1, 2, 3, 4}
    assert {r["n"] for r in found} == {len(good)}
    assert sorted(int(r["deviation"]) for r in found if r["component"] == 1) == sorted(
        sum(int(v) ** 2 for v in row) for row in t
    )
    for c in range(4):
        mine = sorted(r["whitened"] for r in found if r["component"] == c + 1)
        white = (t / len(t)) @ axes[:, c] / np.sqrt(values[c])
        assert min(np.abs(np.sort(s * white) - mine).max() for s in (1, -1)) < 1e-9
        assert next(r["explained"] for r in found if r["component"] == c + 1) == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_spectra_in_any_blocks():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(700, 12)) * 40)
    rows[:, 5] = rows[:, 4]
    rows[100:400] = rows[99]
    exact = np.cov(rows.T, bias=True) * len(rows)
    for cuts in ([], [1, 2, 3], [350], [5, 100, 101, 690]):
        whole = W.Spectrum.empty(12)
        for part in np.split(rows, cuts):
            one = W.Spectrum.empty(12)
            for at in range(0, len(part), 64):
                one.add(part[at : at + 64])
            whole.merge(one)
        assert whole.n == 700 and np.allclose(whole.mean, rows.mean(axis=0))
        assert np.abs(whole.vectors.T @ whole.vectors - np.eye(12)).max() < 1e-12
        assert np.abs(whole.vectors * whole.values @ whole.vectors.T - exact).max() < 1e-9 * exact.max()


def test_rank_one_update_with_equal_and_untouched_directions():
    values, vectors = np.array([0.0, 2.0, 2.0, 2.0, 5.0]), np.eye(5)
    v = np.array([0.0, 1.0, 1.0, 0.0, 1e-20])
    new, axes = W.rank_one(values, vectors, v)
    wanted = np.diag(values) + np.outer(v, v)
    assert np.allclose(new, np.linalg.eigvalsh(wanted))
    assert np.allclose(axes * new @ axes.T, wanted) and np.allclose(axes.T @ axes, np.eye(5))


def test_combining_in_a_tree(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 3)).tolist()
    source = table(spark, vectors).repartition(37).selectExpr("vec_id AS _id", "embedding AS _v")
    found = W.spectrum(source, 3)
    x, t, values, _ = expected(vectors)
    assert found.n == 120 and np.allclose(found.values[::-1] / 120, values)


def test_exact_beyond_64_bits(spark):
    vectors = [[3e10, 1.0], [-3e10, 2.0], [1e10, -5.0]]
    found = W.whiten(table(spark, vectors)).collect()
    _, t, _, _ = expected(vectors)
    assert sorted(int(r["deviation"]) for r in found if r["component"] == 1) == sorted(
        sum(int(v) ** 2 for v in row) for row in t.astype(object)
    )


def test_directions_without_spread(spark):
    flat = [[float(i), 2.0 * i, 7.0] for i in range(20)]
    found = W.whiten(table(spark, flat)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 20
    assert W.whiten(table(spark, [[1.0, 2.0]] * 4)).collect() == []
    assert W.whiten(table(spark, [[1.0, 2.0]])).collect() == []
    assert W.whiten(table(spark, [None, None])).collect() == []
    assert W.whiten(table(spark, [])).columns[0] == "vec_id"


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="1 to 2"):
        W.whiten(table(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(Exception, match="entry of"):
        W.whiten(table(spark, [[1e13], [2.0]])).collect()
