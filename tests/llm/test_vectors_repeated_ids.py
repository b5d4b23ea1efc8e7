"""Vectors: rows that repeat an id with another vector keep their own links, in split buckets too."""

from collections import Counter

import numpy as np

from airgrid.llm import vectors


def test_repeated_ids_with_two_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    rows = [(i, (a + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(-20, 40)]
    rows += [(i, (a + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(0, 40, 2)]     # an id twice, near
    rows += [(i, (b + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(11, 30)]       # an id twice, apart
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    links = near.sum(1) - 1
    apart = np.arange(len(rows)) >= 80
    assert not near[np.ix_(apart, ~apart)].any() and links.min() > 0
    want = Counter((r[0], int(n), 11 if far else -20) for r, n, far in zip(rows, links, apart, strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (16, 1024):
        got = vectors.near_duplicates(df, block=block).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
