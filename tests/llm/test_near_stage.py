"""The near stage of the pipeline against all pairs."""

import random

import corpus_pipeline

from . import cases


def test_near_stage_is_brute_force(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for size in (30, 100, 400, 1000):
        for more in (0.1, 0.18, 0.22, 0.24, 0.27, 0.4):
            base, added = fresh(size), fresh(round(more * size))
            at = rng.choice([0, size // 2, size])
            texts += [" ".join(base), " ".join([*base[:at], *added, *base[at:]])]
        base = fresh(size)
        for edits in (0, 1, 3, size // 50, size // 30):
            copy = list(base)
            for at in rng.sample(range(size), edits):
                copy[at] = fresh(1)[0]
            texts.append(" ".join(copy))
    texts += [None, "", "one", "one two", "ONE two"]
    docs = cases.awkward(spark, texts)
    found = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert found == {i for i, (_, c) in enumerate(cases.near_components(texts, 80, 5)) if i == c}
