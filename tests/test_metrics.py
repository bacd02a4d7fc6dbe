import numpy as np
import pytest
from conftest import rows

from textlab.operators import metrics as M
from textlab.operators import reports


def expected(y, s, p):
    """Metrics from their definitions, pair by pair and threshold by threshold."""
    y, s, p = np.array(y), np.array(s), np.array(p)
    n_pos, n_neg = int(y.sum()), int((1 - y).sum())
    accuracy = float((y == p).mean())
    if not n_pos or not n_neg:
        return (len(y), n_pos, n_neg, accuracy, None, None, None)
    f1 = []
    for c in (0, 1):
        hit, wrong = ((y == c) & (p == c)).sum(), ((y == c) != (p == c)).sum()
        f1.append(2 * hit / (2 * hit + wrong) if hit + wrong else 0.0)
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    auroc = ((pairs > 0).sum() + 0.5 * (pairs == 0).sum()) / pairs.size
    cuts = sorted(set(s), reverse=True)
    fpr = [0.0] + [float((s[y == 0] >= c).mean()) for c in cuts]
    tpr = [0.0] + [float((s[y == 1] >= c).mean()) for c in cuts]
    return (len(y), n_pos, n_neg, accuracy, float(np.mean(f1)), float(auroc), float(np.interp(0.01, fpr, tpr)))


def frame(spark, groups):
    data, names = [], {0: "human", 1: "ai"}
    for g, (y, s, p) in groups.items():
        data += [(g, names[a], float(b), names[c]) for a, b, c in zip(y, s, p)]
    return spark.createDataFrame(data, "g STRING, label STRING, confidence DOUBLE, prediction STRING").repartition(3)


def random_group(seed, n, digits):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.5 + 0.1 * y, 0.2), 0, 1), digits)
    return y.tolist(), s.tolist(), (s > 0.5).astype(int).tolist()


GROUPS = {
    "ties": random_group(1, 300, 1),
    "fine": random_group(2, 400, 12),
    "narrow": (lambda g: (g[0], [0.9 + x * 1e-9 for x in g[1]], g[2]))(random_group(3, 200, 12)),
    "perfect": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1]),
    "reversed": ([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]),
    "equal": ([0, 1, 0, 1], [0.5] * 4, [1, 1, 1, 1]),
    "one class": ([1, 1, 1], [0.1, 0.5, 0.9], [0, 1, 1]),
    "one row": ([0], [0.7], [1]),
    "hundred": ([0] * 100 + [1] * 3, [1 - i / 100 for i in range(100)] + [0.995, 0.5, 0.99], [1] * 103),
}


@pytest.mark.parametrize("small", [10**6, 5])
def test_metrics_match_their_definitions(spark, small):
    got = M.metrics(frame(spark, GROUPS), ["g"], digits=None, small=small)
    for r in got.collect():
        want = expected(*GROUPS[r["g"]])
        assert tuple(r)[1:4] == want[:3], r["g"]
        for a, b in zip(tuple(r)[4:], want[3:]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12), (r["g"], tuple(r), want)


@pytest.mark.parametrize("small", [10**6, 5])
def test_overall_and_by_source(spark, small):
    df = frame(spark, GROUPS | {None: ([1, 0], [0.6, 0.4], [1, 0])})
    got = {r["source_model"]: tuple(r)[1:] for r in M.metrics_by_source(df, "g", digits=None, small=small).collect()}
    assert set(got) == set(GROUPS) | {"unknown", None}
    everything = [sum((list(part) for part in column), []) for column in zip(*GROUPS.values(), ([1, 0], [0.6, 0.4], [1, 0]))]
    want = expected(*everything)
    assert got[None] == pytest.approx(want, abs=1e-12)
    assert got["unknown"] == pytest.approx((2, 1, 1, 1.0, 1.0, 1.0, 1.0))


def test_rounding_and_text_form(spark):
    df = frame(spark, {"a": GROUPS["ties"], "b": GROUPS["one class"]})
    got = M.metrics_by_source(df, "g")
    for r in got.collect():
        assert all(v is None or round(v, 4) == v for v in tuple(r)[4:])
    shown = [tuple(r) for r in M.printable(got).collect()]
    assert [r[0] for r in shown] == [None, "a", "b"]
    assert shown[2][4:] == ("0.6667", "N/A", "N/A", "N/A")


@pytest.mark.parametrize("small", [10**6, 2])
def test_roc_curve(spark, small):
    df = frame(spark, {"a": ([0, 1, 0, 1], [0.2, 0.9, 0.9, 0.5], [0, 1, 1, 1])})
    points = sorted(M.roc_curve(df, small=small).select("fpr", "tpr", "threshold").collect())
    assert [tuple(r) for r in points] == [(0.0, 0.0, None), (0.5, 0.5, 0.9), (0.5, 1.0, 0.5), (1.0, 1.0, 0.2)]


def test_by_split(spark):
    df = frame(spark, {"val": GROUPS["ties"], "test": GROUPS["fine"]}).withColumnRenamed("g", "split")
    got = M.metrics_by_split(df, 10)
    assert got.columns == ["split", "k", "n_records", "n_ai", "n_human", "accuracy", "macro_f1", "auroc", "tpr_at_1fpr"]
    assert {(r["split"], r["k"]) for r in got.collect()} == {("val", 10), ("test", 10)}


def test_reports(spark):
    df = spark.createDataFrame(
        [("ai", "a", "x", "train"), ("ai", "b", "x", "train"), ("human", "b", None, "val"), ("ai", "b", "y", "val")],
        "label STRING, dataset STRING, platform STRING, split STRING",
    )
    assert rows(reports.counts_by(df)) == [
        ("dataset", "a", 1, 25.0), ("dataset", "b", 3, 75.0),
        ("label", "ai", 3, 75.0), ("label", "human", 1, 25.0),
        ("platform", "x", 2, 50.0), ("platform", "y", 1, 25.0), ("platform", None, 1, 25.0),
    ]
    assert rows(reports.split_counts(df)) == [("train", 2, 50.0), ("val", 2, 50.0)]
    assert rows(reports.class_ratio(df)) == [(3, 1, 3.0)]
    assert rows(reports.class_ratio(df.filter("label = 'ai'"))) == [(3, 0, None)]
    assert rows(reports.composition(df)) == [
        ("a", 1, 0, 1, 0, 25.0), ("b", 2, 1, 3, 0, 75.0), (None, 3, 1, 4, 1, 100.0),
    ]
