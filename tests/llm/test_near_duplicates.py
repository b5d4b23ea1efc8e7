"""Vector and text near-duplicates against brute force, and their edge cases."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.llm import omh, vectors
from airgrid.llm.graph import components
from tests.conftest import SF01, SF001


def classes(ids, edges):
    """Smallest id reachable for each id (plain union-find)."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (500, 500), (3, 2)]
    df = spark.createDataFrame(edges, "src long, dst long").unionByName(spark.createDataFrame([(None, 1)], "src long, dst long"))
    got = {r.node: r.component for r in components(df).collect()}
    assert got == classes({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_vectors_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [r.vec_id for r in rows]
    comp = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(1), strict=True)}
    for target, block in ((1024, 1024), (8, 16)):                 # many tables, split buckets
        got = vectors.near_duplicates(df, target=target, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_vectors_groups_of_copies_and_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, base.tolist(), 1) for i in range(30)]                              # exact copies
    rows += [(100 + i, (base + 0.01 * rng.standard_normal(8)).tolist(), 1) for i in range(30)]
    rows += [(200, base.tolist(), 2), (201, base.tolist(), None), (202, None, 1), (203, [0.0] * 8, 1),
             (204, [float("nan")] * 8, 1), (205, [None] * 8, 1), (206, base.tolist()[:4], 1), (None, base.tolist(), 1),
             (5, base.tolist(), 1), (207, [], 1), (208, (1e30 * base).tolist(), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, digest string")
    got = vectors.near_duplicates(df, block=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert len(got) == len(rows)
    x = np.array([r[1] for r in rows[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    extra = (x @ x[0] >= 0.98).astype(int) * 2                                     # the repeated id 5 and the scaled copy
    for i in range(60):
        assert by[rows[i][0]][0].n_links == links[i] + extra[i]
        assert by[rows[i][0]][0].component_id == 0
    assert len(by[5]) == 2 and by[208][0].component_id == 0
    for i in (200, 201, 202, 203, 204, 205, 206, 207):
        assert (by[i][0].n_links, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert (by[None][0].n_links, by[None][0].component_id, by[None][0].kept) == (0, None, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_banded_distance_and_similarity_equal_plain_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 6, rng.integers(0, 14)).astype(np.uint64)
        b = np.array([v for v in a if rng.random() > 0.2] + list(rng.integers(0, 6, rng.integers(0, 4))), dtype=np.uint64)
        d = plain_distance(a, b)
        for limit in (0, 1, 3, 6, 20):
            assert omh.banded_distance(a, b, limit) == min(d, limit + 1)
    words = [f"w{i}" for i in range(80)]
    for _ in range(150):
        w = list(words)
        for _ in range(rng.integers(0, 5)):
            at = rng.integers(0, len(w))
            w[at:at + rng.integers(0, 3)] = [f"x{rng.integers(0, 9)}"] * rng.integers(0, 3)
        if rng.random() < 0.2:
            w = w[40:] + w[:40]
        a, b = omh.shingles(" ".join(words)), omh.shingles(" ".join(w))
        assert omh.similar(a, b) == (plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


@pytest.mark.parametrize("block", [1024, 8])
def test_documents_equal_brute_force(spark, block):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    s = {i: omh.shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if (omh.similar(s[a], s[b]) if len(s[a]) or len(s[b]) else rows[a] == rows[b])]
    want = classes(ids, edges)
    assert len(set(want.values())) < len(ids)
    got = omh.near_duplicates(df, block=block).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    kept = {r.doc_id for r in omh.keep_one(df, "doc_id").collect()}
    assert kept == set(want.values())


def test_chained_copies_in_one_hot_bucket(spark):
    """Copies that drift: only neighbours are similar, and all share sketches."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = list(words)
        for j in range(i):
            w[7 * j + 3] = f"edit{j}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join([f"other{i}_{j}" for j in range(200)] + words[:60])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(df, block=16).collect()}
    assert {got[1000 - i] for i in range(40)} == {961}
    assert all(got[2000 + i] == 2000 + i for i in range(30))


def test_document_edge_cases(spark):
    long = " ".join(f"v{i % 977}" for i in range(30000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "!!!", "a"), (4, "Hello, world", "a"), (5, "hello world!", "b"),
            (6, "hello there", "b"), (None, "hello world", "b"), (None, "quite alone here", "b"), (7, long, "c"),
            (8, long + " tail", "c"), (6, "hello there", "b"), (9, "one two three four five", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = [(r.doc_id, r.class_id, r.kept) for r in omh.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (6, 6, True),
        (None, 4, False), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True)], key=str)
    kept = omh.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 3, 4, 6, None, 7, 9], key=str)
    assert omh.near_duplicates(df.limit(0)).count() == 0
    assert omh.keep_one(df.where(F.lit(False))).count() == 0
