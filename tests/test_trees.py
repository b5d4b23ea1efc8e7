"""Tree learners against exhaustive search, plain boosting and subset enumeration."""

import dataclasses
import itertools
import math
import pickle

import numpy as np
import pandas as pd
import pytest

from airgrid.functions import treekit as kit
from airgrid.functions.treekit import GrowthLimits, Node
from airgrid.operators import explain, trees
from airgrid.operators.search import Study


def frame(spark, x, y, parts=3):
    cols = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(y=y), ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(parts), cols


def made(n=300, width=4, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, width)).astype(float)
    y = np.where(x[:, 0] > 5, 3.0, 0.0) + 0.5 * x[:, 1] + np.where(x[:, 2] == 4, -2.0, 0.0) + rng.normal(0, 0.3, n)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


# ------------------------------------------------------------------ plain versions --

def plain_best(x, g, h, lim, columns):
    """Largest gain over every feature, midpoint and side of the missing values."""
    best = (0.0, None)
    whole = g.sum() ** 2 / (h.sum() + lim.l2)
    for f in columns:
        v = np.unique(x[~np.isnan(x[:, f]), f])
        for thr in [*((v[1:] + v[:-1]) / 2), np.inf]:
            for miss in (False, True):
                left = np.where(np.isnan(x[:, f]), miss, x[:, f] <= thr)
                nl, nr = left.sum(), (~left).sum()
                if min(nl, nr) < max(1, lim.min_leaf) or min(h[left].sum(), h[~left].sum()) < lim.min_weight:
                    continue
                gain = (g[left].sum() ** 2 / (h[left].sum() + lim.l2) + g[~left].sum() ** 2 / (h[~left].sum() + lim.l2) - whole)
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    return best


def plain_predict(x, g, h, lim, columns=None, depth_first=True):
    """Leaf index sets of best-first growth by exhaustive search."""
    columns = range(x.shape[1]) if columns is None else columns
    leaves = [(np.arange(len(x)), 0)]
    while lim.max_leaves is None or len(leaves) < lim.max_leaves:
        found = []
        for k, (rows, depth) in enumerate(leaves):
            if len(rows) < lim.min_split or (lim.max_depth is not None and depth >= lim.max_depth):
                continue
            gain, left = plain_best(x[rows], g[rows], h[rows], lim, columns)
            if left is not None:
                found.append((gain, k, left))
        if not found:
            return leaves
        _, k, left = max(found, key=lambda t: t[0])
        rows, depth = leaves.pop(k)
        leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    return leaves


def leaf_values(leaves, g, h, lim, n):
    out = np.zeros(n)
    for rows, _ in leaves:
        out[rows] = -g[rows].sum() / (h[rows].sum() + lim.l2)
    return out


def grown(x, g, h, lim, allowed=None):
    edges = [(np.unique(c[~np.isnan(c)])[1:] + np.unique(c[~np.isnan(c)])[:-1]) / 2 for c in x.T]
    codes = kit.bin_codes(x, edges)
    root = kit.grow(Node(0, len(x), g.sum(), h.sum(), rows=(codes, g, h)), lim, allowed)
    tree = kit.flatten(root, lambda v: -v.g / (v.h + lim.l2))
    return kit.FlatTrees.join(0.0, [tree], edges), tree


@pytest.mark.parametrize("lim", [GrowthLimits(max_depth=3, min_leaf=5), GrowthLimits(max_leaves=6, min_leaf=3, l2=0.7),
                                 GrowthLimits(max_depth=4, min_split=40, min_leaf=2), GrowthLimits(max_depth=3, min_weight=30.0, l2=1.0)])
def test_a_tree_equals_exhaustive_search(lim):
    x, y = made(160)
    g, h = -(y - y.mean()), np.ones(len(y))
    trees_, tree = grown(x, g, h, lim)
    assert np.allclose(trees_.predict(x), leaf_values(plain_predict(x, g, h, lim), g, h, lim, len(y)))
    leaves = tree["left"] < 0
    assert leaves.sum() <= (lim.max_leaves or len(y)) and tree["cover"][leaves].min() >= max(lim.min_leaf, lim.min_weight)


def test_leaves_grow_in_order_of_gain():
    """A feature whose second split is worth more than all others: both of its splits come first."""
    x = np.column_stack([np.repeat([0.0, 1.0, 2.0, 3.0], 25), np.tile([0.0, 1.0], 50)])
    y = np.repeat([0.0, 0.0, 10.0, 40.0], 25) + 0.5 * x[:, 1]
    _, tree = grown(x, -(y - y.mean()), np.ones(100), GrowthLimits(max_leaves=3))
    inner = tree["left"] >= 0
    assert tree["feature"][inner].tolist() == [0, 0] and tree["bin"][inner].tolist() == [2, 1]
    _, tree = grown(x, -(y - y.mean()), np.ones(100), GrowthLimits(max_leaves=4))
    assert sorted(tree["feature"][tree["left"] >= 0].tolist()) == [0, 0, 1]


def test_missing_values_take_the_better_side():
    x = np.array([[0.0]] * 10 + [[1.0]] * 10 + [[np.nan]] * 10)
    for where, want in (([0] * 10 + [5] * 10 + [5] * 10, 5), ([0] * 10 + [5] * 10 + [0] * 10, 0)):
        y = np.array(where, float)
        t, _ = grown(x, -(y - y.mean()), np.ones(30), GrowthLimits(max_depth=1))
        assert t.predict(np.array([[np.nan]]))[0] + y.mean() == pytest.approx(want)
    y = np.array([1.0] * 20 + [9.0] * 10)
    t, _ = grown(x, -(y - y.mean()), np.ones(30), GrowthLimits(max_depth=1))
    assert (t.predict(np.array([[0.0], [1.0], [np.nan]])) + y.mean()).tolist() == pytest.approx([1, 1, 9])


def plain_boosting(x, y, spec, draws=None):
    score = np.full(len(y), y.mean())
    for t in range(spec.rounds):
        g = score - y
        keep = np.ones(len(y), bool) if draws is None else draws[t]
        mask = trees._draw_columns(x.shape[1], spec.column_share, spec.seed, t)
        cols = range(x.shape[1]) if mask is None else np.flatnonzero(mask)
        fit, _ = grown(x[keep], g[keep], np.ones(keep.sum()), spec.limits, mask)
        if draws is None:
            want = leaf_values(plain_predict(x, g, np.ones(len(y)), spec.limits, cols), g, np.ones(len(y)), spec.limits, len(y))
            assert np.allclose(fit.predict(x), want)
        score = score + spec.learning_rate * fit.predict(x)
    return score


@pytest.mark.parametrize("rows", [10_000, 40, 0])
def test_boosting_equals_plain_boosting(spark, monkeypatch, rows):
    """Nodes sent as rows, as histograms, and both: the same model."""
    monkeypatch.setattr(kit, "rows_limit", lambda f: rows)
    monkeypatch.setattr(trees, "CARRY", 3)
    monkeypatch.setattr(trees, "CHECKPOINT_EVERY", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 64)
    x, y = made(220)
    df, cols = frame(spark, x, y)
    spec = trees.BoostSpec(rounds=9, learning_rate=0.3, max_depth=4, max_leaves=7, min_leaf=6, l2=0.5, column_share=0.75)
    m = trees.fit_trees(df, "m", spec, "y", cols)
    assert np.allclose(m.trees.predict(x), plain_boosting(x, y, spec), atol=1e-9)
    got = {tuple(r[:4]): r.prediction for r in m.transform(df).select(*cols, "prediction").fillna(-1).collect()}
    assert np.allclose(sorted(got.values()), sorted({tuple(np.nan_to_num(a, nan=-1)): p for a, p in zip(x, m.trees.predict(x))}.values()))


def test_a_tree_uses_only_its_drawn_columns_and_rows(spark):
    x, y = made(400, width=8, missing=0)
    df, cols = frame(spark, x, y)
    spec = trees.BoostSpec(rounds=12, max_depth=3, column_share=0.5, row_share=0.4, seed=7)
    m = trees.fit_trees(df, "m", spec, "y", cols)
    ends = [*m.trees.roots[1:], len(m.trees.left)]
    for t, (a, b) in enumerate(zip(m.trees.roots, ends)):
        used = set(m.trees.feature[a:b][m.trees.left[a:b] >= 0].tolist())
        assert used <= set(np.flatnonzero(trees._draw_columns(8, 0.5, 7, t)).tolist())
        assert 100 < m.trees.cover[a] < 220
    assert len({m.trees.cover[a] for a in m.trees.roots}) > 3
    again = trees.fit_trees(df.repartition(5), "m", spec, "y", cols)
    assert np.allclose(again.trees.predict(x), m.trees.predict(x))
    never = trees.fit_trees(df, "m", trees.BoostSpec(rounds=3, max_depth=2, row_share=0.4, row_every=0), "y", cols)
    assert {never.trees.cover[a] for a in never.trees.roots} == {400.0}


@pytest.mark.parametrize("rows", [10_000, 30])
def test_forest_limits_and_paths_agree(spark, monkeypatch, rows):
    x, y = made(300)
    df, cols = frame(spark, x, y)
    spec = trees.ForestSpec(trees=7, max_depth=5, min_split=9, min_leaf=3)
    whole = trees.fit_trees(df, "f", spec, "y", cols).trees.predict(x)
    monkeypatch.setattr(kit, "rows_limit", lambda f: rows)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
    monkeypatch.setattr(trees, "GROUP_NODES", 3)
    data = trees.bin_rows(df, "y", cols)
    held = {}
    for group in data.blocks.collect():
        for c, t, i in zip(*group):
            held.setdefault(int(i), []).append((c, t))
    flat = trees.fit_forest(data, spec, at_once=4)
    assert np.allclose(flat.predict(x), whole)
    ids = np.array(sorted(held), np.uint64)
    for t, (a, b) in enumerate(zip(flat.roots, [*flat.roots[1:], len(flat.left)])):
        w = kit.bootstrap(ids, spec.seed, t)
        codes = np.array([held[int(i)][0][0] for i in ids])[w > 0]
        tree = {k: getattr(flat, k)[a:b] for k in ("feature", "missing_left", "left", "right")}
        tree["left"], tree["right"] = tree["left"] - np.where(tree["left"] >= 0, a, 0), tree["right"] - np.where(tree["right"] >= 0, a, 0)
        edges = [np.append(e, np.inf) for e in data.edges]
        tree["bin"] = np.array([np.searchsorted(edges[f], v) for f, v in zip(flat.feature[a:b], flat.threshold[a:b])])
        at = kit.leaf_of(tree, codes)
        inner, depth = tree["left"] >= 0, np.zeros(b - a, int)
        for i in np.flatnonzero(inner):
            depth[[tree["left"][i], tree["right"][i]]] = depth[i] + 1
        assert np.bincount(at, minlength=b - a)[~inner].min() >= 3 and depth.max() <= 5
        assert flat.cover[a] == w.sum() and np.isclose(np.bincount(at, w[w > 0], b - a)[~inner], flat.cover[a:b][~inner]).all()


@pytest.mark.parametrize(("rows", "blocks"), [(10_000, 65_536), (40, 64), (0, 64)])
def test_only_splits_of_boosted_trees_reach_the_driver(spark, monkeypatch, rows, blocks):
    """What a job returns is far less than the rows or a histogram of a node, and follows the splits."""
    from pyspark import RDD
    seen, collect, reduce = [], RDD.collect, RDD.treeReduce

    def collected(self):
        seen.append(collect(self))
        return seen[-1]

    def reduced(self, *a, **k):
        seen.append(reduce(self, *a, **k))
        return seen[-1]
    monkeypatch.setattr(kit, "rows_limit", lambda f: rows)
    monkeypatch.setattr(trees, "BLOCK_ROWS", blocks)
    x, y = made(900)
    df, cols = frame(spark, x, y)
    data = trees.bin_rows(df, "y", cols)
    monkeypatch.setattr(RDD, "collect", collected)
    monkeypatch.setattr(RDD, "treeReduce", reduced)
    spec = trees.BoostSpec(rounds=4, max_depth=4, max_leaves=9, min_leaf=5)
    trees.fit_boosting(data, spec)
    assert seen and max(len(pickle.dumps(r)) for r in seen) < 4_000
    trees.fit_forest(data, trees.ForestSpec(trees=2, max_depth=3, min_leaf=3))
    assert max(len(pickle.dumps(r)) for r in seen) < 4_000


def test_a_leaf_of_one_block_is_grown_in_one_job(spark, monkeypatch):
    """A tree whose root's children fit a block takes two jobs, and no more tasks than blocks look for splits."""
    from pyspark import RDD
    x, y = made(500, missing=0)
    df, cols = frame(spark, x, y)
    spec = trees.BoostSpec(rounds=2, max_depth=5, max_leaves=9, min_leaf=5)
    whole = trees.fit_trees(df, "m", spec, "y", cols).trees.predict(x)
    monkeypatch.setattr(kit, "rows_limit", lambda f: 10)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 450)
    data = trees.bin_rows(df, "y", cols)
    tasks, collect = [], RDD.collect

    def collected(self):
        tasks.append(self.getNumPartitions())
        return collect(self)
    monkeypatch.setattr(RDD, "collect", collected)
    got = trees.fit_boosting(data, spec)
    blocks = data.blocks.getNumPartitions()
    assert blocks > 1 and len(tasks) == 2 * spec.rounds and max(tasks) <= blocks
    assert np.allclose(got.predict(x), whole)


def test_splits_found_ahead_give_the_tree_of_single_steps():
    """A subtree grown with the leaves that are left holds all that best-first growth takes from it."""
    x, y = made(500, missing=0)
    edges = [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
    edges = [e[::max(1, len(e) // 200)] for e in edges]
    codes, g, lim = kit.bin_codes(x, edges), y.mean() - y, GrowthLimits(max_leaves=12, min_leaf=4)
    want = kit.flatten(kit.grow(Node(0, 500, g.sum(), 500.0, rows=(codes, g, None)), lim), lambda v: v.g)

    def fetch(root, nodes, left):
        shape = kit.flatten(root, lambda v: 0.0, known=True)
        held = shape.pop("nodes")
        at = kit.leaf_of(shape, codes)
        for k in (k for node in nodes for k in node.kids):
            here = at == next(i for i, v in enumerate(held) if v is k)
            grown_ = Node(k.depth, k.n, k.g, k.h, rows=(codes[here], g[here], None))
            kit.hang(k, kit.found_splits(kit.grow(grown_, dataclasses.replace(lim, max_leaves=left))))
    root = Node(0, 500, g.sum(), 500.0)
    top = Node(0, 500, g.sum(), 500.0, rows=(codes, g, None))
    root.known, root.split = True, kit.best(top, lim)
    got = kit.flatten(kit.grow(root, lim, None, fetch), lambda v: v.g)
    for k in ("feature", "bin", "missing_left", "left", "right", "cover"):
        assert got[k].tolist() == want[k].tolist()
    assert np.allclose(got["value"], want["value"])


def test_packed_trees_come_back_whole():
    x, y = made(300)
    for h in (np.ones(300), np.linspace(0.1, 3.0, 300)):
        _, tree = grown(x, -y, h, GrowthLimits(min_leaf=3))
        del tree["nodes"]
        back = kit.unpack(kit.pack(tree))
        assert all(back[k].dtype == tree[k].dtype and (back[k] == tree[k]).all() for k in tree)
        assert len(kit.pack(tree)) < 0.6 * sum(v.nbytes for v in tree.values())
    one = {k: v[:1] for k, v in tree.items()} | {"left": np.array([-1], np.int32), "right": np.array([-1], np.int32)}
    one |= {"feature": np.zeros(1, np.int32), "bin": np.zeros(1, np.int32), "missing_left": np.zeros(1, bool)}
    assert all((kit.unpack(kit.pack(one))[k] == one[k]).all() for k in one)


def test_edges_and_edge_tables(spark):
    x = np.column_stack([np.arange(1000.0), np.repeat([1.0, 2.0], 500), np.full(1000, np.nan), np.zeros(1000)])
    df, cols = frame(spark, x, np.arange(1000.0))
    e = trees.bin_edges(df, cols, 10)
    assert np.allclose(e[0], np.quantile(np.arange(1000), np.arange(1, 10) / 10)) and e[1].tolist() == [1.5]
    assert len(e[2]) == 0 and len(e[3]) == 0
    m = trees.fit_trees(df, "m", trees.BoostSpec(rounds=2, max_depth=2, max_bins=10), "y", cols)
    assert m.trees.predict(x[:1])[0] < m.trees.predict(x[-1:])[0]
    empty = trees.fit_trees(df.limit(0), "e", trees.BoostSpec(rounds=2), "y", cols)
    assert empty.trees.predict(x[:2]).tolist() == [0.0, 0.0]
    flat = trees.fit_trees(df.withColumn("y", df.y * 0 + 4), "c", trees.ForestSpec(trees=3), "y", cols)
    assert np.allclose(flat.trees.predict(x[:3]), 4)


# ------------------------------------------------------------------ attributions --

def plain_shapley(t, x):
    """Subset enumeration of the game whose unknown features go both ways by cover."""
    width = x.shape[1]

    def value(row, known):
        def walk(i):
            if t.left[i] < 0:
                return t.value[i]
            f = t.feature[i]
            kids = (t.left[i], t.right[i])
            if f in known:
                left = t.missing_left[i] if np.isnan(row[f]) else row[f] <= t.threshold[i]
                return walk(kids[0] if left else kids[1])
            return sum(walk(k) * t.cover[k] / t.cover[i] for k in kids)
        return t.base + sum(walk(r) for r in t.roots)
    out = np.zeros(x.shape)
    for r, row in enumerate(x):
        v = {s: value(row, s) for k in range(width + 1) for s in map(frozenset, itertools.combinations(range(width), k))}
        for f in range(width):
            for s, without in v.items():
                if f not in s:
                    out[r, f] += math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) * (v[s | {f}] - without)
    return out, value(x[0], frozenset())


def test_attributions_equal_subset_enumeration(spark):
    x, y = made(250, width=8)
    df, cols = frame(spark, x, y)
    for spec in (trees.BoostSpec(rounds=6, max_depth=6, max_leaves=20, min_leaf=4), trees.ForestSpec(trees=3, max_depth=7, min_leaf=2)):
        m = trees.fit_trees(df, "m", spec, "y", cols)
        phi, base = m.trees.attributions(x[:5])
        want, empty = plain_shapley(m.trees, x[:5])
        assert np.allclose(phi, want, atol=1e-9) and base == pytest.approx(empty)
        whole, base = m.trees.attributions(x)
        assert np.abs(whole.sum(axis=1) + base - m.trees.predict(x)).max() < 1e-9
    rows = explain.tree_values(df, m, ["y"]).collect()
    assert len(rows) == 250 and np.allclose(sorted(r.base + sum(r.phi) for r in rows), sorted(m.trees.predict(x)))
    imp = {r.feature: r.importance for r in explain.tree_attributions(df, m).collect()}
    assert np.allclose([imp[c] for c in cols], np.abs(whole).mean(axis=0))
    assert explain.tree_attributions(df, m, top=2).count() == 2


# ------------------------------------------------------------------ search --------

SPACE = {"a": ("float", -5.0, 5.0), "n": ("int", 1, 40), "r": ("log", 1e-4, 1.0), "c": ("cat", ["x", "y", None])}


def loss(t):
    return (t["a"] - 2) ** 2 + ((t["n"] - 30) / 10) ** 2 + (math.log10(t["r"]) + 2) ** 2 + (0 if t["c"] == "y" else 2)


def best_of(seed, startup, batch=5, n=60):
    study = Study(SPACE, seed, startup)
    while len(study.trials) < n:
        for t in study.ask(batch):
            study.tell(t, loss(t))
    return min(v for v, _ in study.trials), [t for _, t in study.trials]


def test_search_is_deterministic_and_better_than_random():
    assert best_of(1, 10) == best_of(1, 10)
    guided, uniform = [best_of(s, 10)[0] for s in range(12)], [best_of(s, 60)[0] for s in range(12)]
    assert np.mean(guided) < 0.6 * np.mean(uniform) and np.median(guided) < np.median(uniform)


def test_search_with_trees_on_folds(spark):
    from datetime import datetime, timedelta

    from airgrid.operators import models
    from airgrid.schemas import FEATURES, TARGET
    rng = np.random.default_rng(2)
    rows = [("s", datetime(2024, 1, 1) + timedelta(hours=i), float(np.exp(1 + 0.3 * v[0])), *map(float, v))
            for i, v in enumerate(rng.normal(size=(150, len(FEATURES))))]
    df = spark.createDataFrame(rows, f"location string, datetime timestamp, {TARGET} double, " + ", ".join(f"{f} double" for f in FEATURES))
    small = {"rounds": ("int", 2, 6), "learning_rate": ("log", 0.05, 0.5), "max_bins": ("int", 64, 66)}
    got = models.cv_search(df, {"kind": "boost", "max_depth": 2}, small, trials=4, folds=2, batch=2, startup=2).collect()
    assert len(got) == 4 and all(r.cv_mae > 0 for r in got)
    again = models.cv_search(df, {"kind": "boost", "max_depth": 2}, small, trials=4, folds=2, batch=2, startup=2, parallel=1).collect()
    assert [(r.params, round(r.cv_mae, 9)) for r in got] == [(r.params, round(r.cv_mae, 9)) for r in again]
