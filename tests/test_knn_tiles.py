"""Candidates are scored a tile at a time, within bounded memory."""

import tracemalloc

import numpy as np
import pytest

from textlab.operators import knn


def brute(ids, points, query_ids, queries, k, exclude_self):
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
    a, b = unit(queries), unit(points)
    found = []
    for q, row in zip(query_ids, a):
        scores = (row * b).sum(axis=1)
        ranked = [i for i in np.lexsort((ids, -scores)) if not (exclude_self and ids[i] == q)]
        found += [(int(q), int(ids[i]), float(scores[i])) for i in ranked[:k]]
    return found


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("held", [knn.HELD_HITS, 50])
def test_tiles_give_the_rows_of_brute_force(monkeypatch, exclude_self, held):
    monkeypatch.setattr(knn, "TILE", 32)
    monkeypatch.setattr(knn, "FIRST_SCORES", 8)
    monkeypatch.setattr(knn, "HELD_HITS", held)
    draw = np.random.default_rng(3)
    # Few different values: many equal scores, many copies, some zero rows.
    points = draw.integers(-1, 2, (300, 4)).astype(float)
    ids = draw.permutation(1000)[:300]
    k = 7
    block = knn.Candidates(ids, points, k)
    hits = [(int(ids[q]), int(block.ids[c]), s) for qs, cs, ss in block.search(ids, points, k, exclude_self)
            for q, c, s in zip(qs, cs, ss.tolist())]
    wanted = brute(ids, points, ids, points, k, exclude_self)
    assert [h[:2] for h in hits] == [w[:2] for w in wanted]
    assert np.allclose([h[2] for h in hits], [w[2] for w in wanted])


def test_copies_are_numbered_in_order():
    rows = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [0.0, 0.0], [1.0, 2.0], [3.0, 4.0]])
    assert knn._copy_numbers(rows).tolist() == [0, 0, 1, 0, 2, 1]


def test_a_block_pair_takes_a_few_times_its_block():
    draw = np.random.default_rng(4)
    points = draw.normal(size=(131_072, 64))
    ids = np.arange(len(points))
    tracemalloc.start()
    block = knn.Candidates(ids, points, 10)
    for _ in block.search(ids[:3000], points[:3000], 10, False):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The rows scaled to one in both precisions are 1.5 blocks.
    assert peak < 3 * points.nbytes
