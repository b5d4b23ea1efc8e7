"""Histogram tree learners (M02-M05, M07): boosting and forests on bin codes.

Features become one byte a value, once: exact quantile edges, code 255 for a missing
value, whose side every split learns.  The codes, the target and a hash of each row are
a stored table; a fit reads it as blocks of numpy arrays, one or more a partition.

* Boosting: a Spark job asks every block for what the open leaves of a tree hold: a
  (feature, bin) histogram of gradients, or the rows themselves where these fit one
  block.  They are dealt by leaf; the task of a leaf merges its histograms and looks for
  the split, or grows the whole subtree from its rows.  Only splits reach the driver,
  which lets leaves grow best first; a table of one block needs no dealing.  Every task
  tells the driver about itself (2 to 3 KB), so a tree takes few jobs.  Scores of
  the blocks are carried from round to round in a persisted state that is checkpointed
  from time to time.
* Forests: many trees grow at once.  Large nodes are reduced to histograms and split by
  (tree, node) after a shuffle; small nodes meet their rows in one task, which grows the
  subtree; only splits and packed subtrees reach the driver.

Row and column draws are functions of row hash, seed and tree, so a lost block is made
again with the same draws.  Blocks are an RDD: an iteration is one short pass over
per-partition arrays, as in Spark ML's own boosting.
"""

from __future__ import annotations

import functools
import json
import pickle
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import treekit as kit
from airgrid.functions.quantiles import exact_quantiles_many
from airgrid.functions.treekit import FlatTrees, GrowthLimits, Node
from airgrid.schemas import FEATURES
from airgrid.session import ensure_checkpoint_dir, scratch_path

BLOCK_ROWS = 65_536          # rows of one block of arrays
CARRY = 16                   # rounds whose trees are applied on the fly before scores are carried on
CHECKPOINT_EVERY = 8         # carried states between two checkpoints
GROUP_NODES = 256            # nodes whose histograms one forest job makes


@dataclass(frozen=True)
class BoostSpec:
    """Gradient boosting of squared error from the mean of the target."""
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int | None = None             # None, 0 or less: no limit
    max_leaves: int | None = None
    min_leaf: int = 1
    min_weight: float = 0.0
    l2: float = 0.0
    max_bins: int = 255
    row_share: float = 1.0
    row_every: int = 1                       # draw rows anew in every ... rounds; 0: never draw
    column_share: float = 1.0                # one draw of columns a tree
    seed: int = 42

    @property
    def limits(self) -> GrowthLimits:
        return _limits(self)


@dataclass(frozen=True)
class ForestSpec:
    """Bagged trees; ``columns``: share of the features each tree draws, or sqrt / log2 / None for all."""
    trees: int = 100
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    columns: float | str | None = None       # draws are per tree
    max_bins: int = 255
    seed: int = 42

    @property
    def limits(self) -> GrowthLimits:
        return _limits(self)


def _limits(spec) -> GrowthLimits:
    deep = spec.max_depth if spec.max_depth is not None and spec.max_depth > 0 else None
    return GrowthLimits(max_depth=deep, max_leaves=getattr(spec, "max_leaves", None), min_leaf=spec.min_leaf,
                        min_split=getattr(spec, "min_split", 2), min_weight=getattr(spec, "min_weight", 0.0),
                        l2=getattr(spec, "l2", 0.0))


# ------------------------------------------------------------------ bin codes --

@dataclass
class Binned:
    """Bin codes of a training set: stored blocks, edges and the number of rows."""
    features: list[str]
    edges: list[np.ndarray]
    blocks: RDD                              # (codes, target, row hash)
    n: int
    mean: float


def bin_edges(df: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Edges between bins: midpoints of neighbouring values where a feature has at most
    ``max_bins`` of them, else the exact quantiles that cut it into ``max_bins``.  At most 255 bins."""
    if not 2 <= max_bins <= kit.MISSING:
        raise ValueError(f"max_bins must be between 2 and {kit.MISSING}")
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])
    values = (df.select(F.explode(entries).alias("e")).select("e.i", "e.v")
              .where(F.col("v").isNotNull() & ~F.isnan("v")).distinct())
    few = values.groupBy("i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_bins)
    known: dict[int, list[float]] = {}
    for r in values.join(few, "i").select("i", "v").collect():          # at most max_bins a feature
        known.setdefault(r["i"], []).append(r["v"])
    counted = {r["i"] for r in few.collect()}
    rest = [c for i, c in enumerate(features) if i not in counted]
    cuts = exact_quantiles_many(df, rest, [k / max_bins for k in range(1, max_bins)]) if rest else {}
    out = []
    for i, c in enumerate(features):
        if i in counted:
            v = np.sort(np.array(known[i]))
            apart = np.diff(v) > _slack(v[1:])
            out.append(((v[1:] + v[:-1]) / 2)[apart])
        else:
            v = np.unique(np.array([x for x in cuts[c] if x is not None]))
            v = v[np.append(True, np.diff(v) > 2 * _slack(v[1:]))] if len(v) else v
            out.append(v + _slack(v))                    # a value at an edge stays below it
    return out


def _slack(v: np.ndarray) -> np.ndarray:
    """Values closer than this are one value: sums and sines of another engine differ in the last digits."""
    return 1e-9 * np.maximum(1.0, np.abs(v))


def bin_rows(df: DataFrame, target: str, features: list[str] = FEATURES, max_bins: int = 255,
             edges: list[np.ndarray] | None = None) -> Binned:
    """Store the codes, target and hash of every row and open them as blocks.

    Rows without a target are left out.  A row's hash is of its features, its target
    and its columns of other names, so equal rows share their draws.
    """
    edges = edges if edges is not None else bin_edges(df, features, max_bins)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(edges)         # features x 254 numbers at most
    cols = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    others = [F.col(f"`{c}`") for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]
    rows = df.where(F.col(target).isNotNull()).select(
        *cols, F.col(target).cast("double").alias("y"), F.xxhash64(*others).alias("id"))
    width = len(features)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f.iloc[:, :width].to_numpy(dtype="float64", na_value=np.nan)
            codes = kit.bin_codes(x, shared.value)
            yield pd.DataFrame({"codes": [c.tobytes() for c in codes], "y": f["y"], "id": f["id"]})

    path = scratch_path(spark, "bin-codes")
    rows.mapInPandas(encode, "codes binary, y double, id long").write.parquet(path)
    stored = spark.read.schema("codes binary, y double, id long").parquet(path)

    def blocks(part: Iterator) -> Iterator[tuple]:
        held: list = []
        for r in part:
            held.append(r)
            if len(held) >= BLOCK_ROWS:
                yield _block(held, width)
                held = []
        if held:
            yield _block(held, width)

    size = stored.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).first()
    parts = max(1, -(-size["n"] // BLOCK_ROWS))
    laid = stored.coalesce(parts) if parts < stored.rdd.getNumPartitions() else stored
    rdd = laid.rdd.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    return Binned(features, edges, rdd, size["n"], float(size["mean"] or 0.0))


def _block(rows: list, width: int) -> tuple:
    codes = np.frombuffer(b"".join(bytes(r["codes"]) for r in rows), np.uint8).reshape(len(rows), width)
    return (codes, np.array([r["y"] for r in rows]), np.array([r["id"] for r in rows], np.int64).view(np.uint64))


def _draw_columns(width: int, share: float | str | None, seed: int, tree: int) -> np.ndarray | None:
    n = {None: width, "all": width, "sqrt": int(width ** 0.5), "log2": int(np.log2(max(width, 2)))}.get(
        share, None) if not isinstance(share, float) else int(share * width)
    n = max(1, n)
    if n >= width:
        return None
    allowed = np.zeros(width, bool)
    allowed[random.Random(f"{seed}-{tree}").sample(range(width), n)] = True
    return allowed


# ------------------------------------------------------------------ boosting ----

def _merge(a: dict, b: dict) -> dict:
    """Contents of nodes of two blocks, in block order."""
    for k, (kind, held) in b.items():
        if k not in a:
            a[k] = (kind, held)
        elif kind == "hist":
            a[k] = (kind, a[k][1] + held)
        else:
            a[k] = (kind, tuple(np.concatenate(p) for p in zip(a[k][1], held, strict=True)))
    return a


@dataclass
class _Boosting:
    """The state of one fit: blocks with scores, and trees not yet in them."""
    data: Binned
    spec: BoostSpec
    state: RDD = None
    pending: list = field(default_factory=list)
    carried: int = 0
    whole: bool = False

    def __post_init__(self):
        parts = self.data.blocks.getNumPartitions()
        self.whole = parts == 1 and self.data.n <= BLOCK_ROWS          # its one block meets in one task anyway
        self.state = self.data.blocks.mapPartitions(_Start(self.data.mean))
        self.state.persist(StorageLevel.MEMORY_AND_DISK)

    def carry(self) -> None:
        """Put the pending trees into the scores; the old state goes when the new one is held."""
        trees, old = self.pending, self.state
        self.state = old.mapPartitions(_Carry(trees))
        self.state.persist(StorageLevel.MEMORY_AND_DISK)
        self.carried += 1
        if self.carried % CHECKPOINT_EVERY == 0:
            ensure_checkpoint_dir(SparkSession.active())
            self.state.checkpoint()
        self.state.count()
        old.unpersist()
        self.pending = []

    def splits(self, tree: int, shape: dict | None, wanted: dict[int, tuple], lim: GrowthLimits, allowed) -> dict:
        """For leaf -> ("hist" or "rows", leaf or None for the root): its rows, g, h and splits, found in tasks."""
        spec = self.spec
        sampled = spec.row_share < 1.0 and spec.row_every > 0
        look = _Look(self.pending, shape, {i: kind for i, (kind, _) in wanted.items()}, spec.row_share if sampled else None,
                     spec.seed, tree // spec.row_every if sampled else 0)
        find = _Find({i: leaf for i, (_, leaf) in wanted.items()}, lim, allowed)
        held = self.state.mapPartitions(look)
        if not self.whole:
            place = {i: k for k, i in enumerate(wanted)}
            tasks = min(len(wanted), self.state.getNumPartitions(), self.state.context.defaultParallelism)
            held = held.partitionBy(tasks, place.__getitem__)
        return dict(held.mapPartitions(find).collect())

    def close(self) -> None:
        self.state.unpersist()


# Task functions as classes, and trees as bytes: they pickle fast, which a short job notices.

@dataclass
class _Start:
    mean: float

    def __call__(self, blocks: Iterator[tuple]) -> Iterator[tuple]:
        for b in blocks:
            yield (*b, np.full(len(b[1]), self.mean))


@dataclass
class _Carry:
    trees: list

    def __call__(self, blocks: Iterator[tuple]) -> Iterator[tuple]:
        for b in blocks:
            yield (*b[:3], _advance(b, self.trees))


@dataclass
class _Look:
    """Contents of the wanted nodes in the blocks of a partition."""
    trees: list
    shape: dict | None
    wanted: dict
    share: float | None
    seed: int
    epoch: int

    def one(self, block: tuple) -> dict:
        codes, y, ids, _ = block
        g = _advance(block, self.trees) - y
        if self.share is not None:
            kept = kit.draw(ids, self.seed, self.epoch) < self.share
            codes, g = codes[kept], g[kept]
        at = kit.leaf_of(self.shape, codes) if self.shape is not None else None
        out = {}
        for i, kind in self.wanted.items():
            c, gi = (codes, g) if at is None else (codes[at == i], g[at == i])
            out[i] = (kind, kit.histogram(c, gi, None) if kind == "hist" else (c, gi))
        return out

    def __call__(self, blocks: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for i, held in functools.reduce(_merge, map(self.one, blocks), {}).items():
            yield i, (part, held)


@dataclass
class _Find:
    """Splits of the leaves whose contents come together in a task, merged in the order of the blocks."""
    leaves: dict
    lim: GrowthLimits
    allowed: np.ndarray | None

    def __call__(self, contents: Iterator[tuple]) -> Iterator[tuple]:
        met: dict[int, list] = {}
        for i, piece in contents:
            met.setdefault(i, []).append(piece)
        for i in sorted(met):
            kind, held = functools.reduce(_merge, ({i: h} for _, h in sorted(met.pop(i), key=lambda p: p[0])), {})[i]
            leaf, lim = self.leaves[i], self.lim
            if leaf is None:
                g, h, n = held[0].sum(axis=0) if kind == "hist" else (held[1].sum(), float(len(held[1])), len(held[1]))
                leaf = (0, int(n), float(g), float(h))
            node = Node(*leaf)
            if kind == "rows":
                node.rows = (*held, None)
                found = kit.found_splits(kit.grow(node, lim, self.allowed))
            else:
                node.hist = held
                found = kit.best(node, lim, self.allowed)
            yield i, (leaf, kind, found)


def _advance(block: tuple, trees: list[bytes]) -> np.ndarray:
    """Scores of a block after some more (pickled) trees."""
    score = block[3]
    for t in map(pickle.loads, trees):
        score = score + t["value"][kit.leaf_of(t, block[0])]
    return score


def _few(data: Binned) -> int:
    """Rows of a forest's node that travel as such: no more room than a histogram from every partition, one block at most."""
    return min(kit.rows_limit(len(data.features)) * data.blocks.getNumPartitions(), BLOCK_ROWS)


def _put(node: Node, kind: str, splits) -> None:
    if kind == "rows":
        kit.hang(node, splits)
    else:
        node.known, node.split = True, splits


def fit_boosting(data: Binned, spec: BoostSpec) -> FlatTrees:
    """Trees of all rounds, uncut."""
    if data.n == 0:
        return FlatTrees.join(0.0, [], data.edges)
    # a leaf of one block at most is grown to its end in one job, where histograms take a job a level
    fit, lim, few = _Boosting(data, spec), spec.limits, BLOCK_ROWS
    trees = []
    try:
        for t in range(spec.rounds):
            allowed = _draw_columns(len(data.features), spec.column_share, spec.seed, t)

            def fetch(root: Node, nodes: list[Node], left: int | None, t: int = t, allowed=allowed) -> None:
                shape = kit.flatten(root, lambda x: 0.0, known=True)
                place = {id(x): i for i, x in enumerate(shape.pop("nodes"))}
                kids = {place[id(k)]: k for x in nodes for k in x.kids}
                # the node to be split takes one of the leaves that are left
                wanted = {i: ("rows" if k.n <= few else "hist", (k.depth, k.n, k.g, k.h)) for i, k in kids.items()
                          if kit._splittable(k, lim) and (left is None or left > 1)}
                found = fit.splits(t, shape, wanted, replace(lim, max_leaves=left), allowed) if wanted else {}
                for i, k in kids.items():
                    _, kind, splits = found.get(i, (None, "rows", [None]))
                    _put(k, kind, splits)

            root_leaf, kind, splits = fit.splits(t, None, {0: ("rows" if data.n <= few else "hist", None)}, lim, allowed)[0]
            root = Node(*root_leaf)
            _put(root, kind, splits)
            kit.grow(root, lim, allowed, fetch)
            tree = kit.flatten(root, lambda x: -spec.learning_rate * x.g / (x.h + lim.l2) if x.h + lim.l2 > 0 else 0.0)
            del tree["nodes"]
            trees.append(tree)
            fit.pending.append(pickle.dumps({k: tree[k] for k in ("feature", "bin", "missing_left", "left", "right", "value")}))
            if len(fit.pending) >= CARRY:
                fit.carry()
    finally:
        fit.close()
    return FlatTrees.join(data.mean, trees, data.edges)


# ------------------------------------------------------------------ forests -----

def _gini_rows(block: tuple, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In-bag codes, -y * weight and weight of one tree."""
    codes, y, ids = block
    w = kit.bootstrap(ids, seed, tree)
    bag = w > 0
    return codes[bag], -y[bag] * w[bag], w[bag]


def fit_forest(data: Binned, spec: ForestSpec, at_once: int = 256) -> FlatTrees:
    """All trees, ``at_once`` of them growing together."""
    if data.n == 0:
        return FlatTrees.join(0.0, [], data.edges)
    trees = []
    for lo in range(0, spec.trees, at_once):
        trees += _fit_group(data, spec, range(lo, min(lo + at_once, spec.trees)))
    return FlatTrees.join(0.0, trees, data.edges, 1.0 / max(1, len(trees)))


def _fit_group(data: Binned, spec: ForestSpec, ids: range) -> list[dict]:
    lim, few, seed, width = spec.limits, _few(data), spec.seed, len(data.features)
    masks = {t: _draw_columns(width, spec.columns, seed, t) for t in ids}
    roots = {t: Node(0, data.n, 0.0, 0.0) for t in ids}          # a bag never has more rows than the data
    parts = max(data.blocks.getNumPartitions(), min(len(ids), 4 * data.blocks.context.defaultParallelism))

    def shapes() -> tuple[dict, dict]:
        flat = {t: kit.flatten(r, lambda x: 0.0) for t, r in roots.items()}
        held = {t: f.pop("nodes") for t, f in flat.items()}
        return flat, held

    open_nodes = [(t, r) for t, r in roots.items()]
    while True:
        large = [(t, x) for t, x in open_nodes if x.n > few and kit._splittable(x, lim)]
        if not large:
            break
        flat, held = shapes()
        found: dict[tuple, tuple] = {}
        for at in range(0, len(large), GROUP_NODES):
            wanted: dict[int, list[int]] = {}
            for t, x in large[at:at + GROUP_NODES]:
                wanted.setdefault(t, []).append(next(i for i, y in enumerate(held[t]) if y is x))
            some = {t: flat[t] for t in wanted}

            def pieces(block: tuple, wanted=wanted, some=some) -> Iterator[tuple]:
                for t, nodes in wanted.items():
                    codes, g, w = _gini_rows(block, seed, t)
                    leaf = kit.leaf_of(some[t], codes)
                    for i in nodes:
                        here = leaf == i
                        if here.any():
                            yield (t, i), kit.histogram(codes[here], g[here], w[here])

            def split(item: tuple) -> tuple:
                (t, i), hist = item
                g, h, n = hist[0].sum(axis=0)
                return (t, i), (float(g), float(h), int(n), kit.best_split(hist, float(g), float(h), int(n), lim, masks[t])
                                if n >= max(lim.min_split, 2 * lim.min_leaf) else None)

            found.update(data.blocks.flatMap(pieces).reduceByKey(lambda a, b: a + b, parts).map(split).collect())
        nxt = []
        for t, x in large:
            i = next(i for i, y in enumerate(held[t]) if y is x)
            x.g, x.h, x.n, x.split = found.get((t, i), (0.0, 0.0, 0, None))
            if x.split:
                x.kids, x.attached = kit._children(x), True
                nxt += [(t, k) for k in x.kids]
        done_now = {id(x) for _, x in large}
        open_nodes = [(t, x) for t, x in open_nodes if id(x) not in done_now] + nxt
    flat, held = shapes()
    wanted = {}
    for t, x in open_nodes:
        if x.n <= few and (kit._splittable(x, lim) or x.depth == 0):     # others are leaves whose sums are known
            i = next(i for i, y in enumerate(held[t]) if y is x)
            wanted.setdefault(t, {})[i] = x.depth

    def small(block: tuple) -> Iterator[tuple]:
        for t, nodes in wanted.items():
            codes, g, w = _gini_rows(block, seed, t)
            leaf = kit.leaf_of(flat[t], codes)
            for i in nodes:
                here = leaf == i
                yield (t, i), (codes[here], g[here], w[here])

    def finish(item: tuple) -> tuple:
        (t, i), blocks = item
        codes, g, w = (np.concatenate(p) for p in zip(*blocks, strict=True))
        order = np.lexsort((w, g, *codes.T))                  # the same sums wherever the blocks came from
        codes, g, w = codes[order], g[order], w[order]
        root = Node(wanted[t][i], len(g), float(g.sum()), float(w.sum()), rows=(codes, g, w))
        kit.grow(root, lim, masks[t])
        return (t, i), kit.pack(kit.flatten(root, lambda x: -x.g / x.h if x.h > 0 else 0.0))

    done = dict(data.blocks.flatMap(small).groupByKey(parts).map(finish).collect())
    return [_graft(flat[t], held[t], {i: kit.unpack(done.pop((t, i))) for i in wanted.get(t, {}) if (t, i) in done}) for t in ids]


def _graft(top: dict, nodes: list[Node], under: dict[int, dict]) -> dict:
    """Put subtrees in the place of leaves of ``top``."""
    out = {k: v.copy() for k, v in top.items()}
    out["cover"] = np.array([x.h for x in nodes])
    out["value"] = np.array([-x.g / x.h if x.h > 0 else 0.0 for x in nodes])
    for i, sub in under.items():
        shift = len(out["left"]) - 1                          # the subtree's root takes the leaf's place
        moved = {k: v.copy() for k, v in sub.items()}
        inner = moved["left"] >= 0
        moved["left"][inner] += shift
        moved["right"][inner] += shift
        for k, v in moved.items():
            out[k][i] = v[0]
            out[k] = np.concatenate([out[k], v[1:]])
    return out


# ------------------------------------------------------------------ models ------

_NODES = ("tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, "
          "value double, cover double")


@dataclass
class TreeModel:
    """A fitted ensemble with the ``transform`` contract of the other models.  Missing values stay missing."""
    name: str
    features: list[str]
    trees: FlatTrees
    spec: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (log space)."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)      # bounded by the size of the model

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                yield pd.Series(shared.value.predict(np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in cols])))
        score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return df.withColumn("prediction", F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.features]))

    def predict(self, df: DataFrame, name: str = "pm25_pred") -> DataFrame:
        return self.transform(df).withColumn(name, F.greatest(F.lit(0.0), F.expm1(F.col("prediction")))).drop("prediction")

    def save(self, path: str) -> None:
        """One row per node, and one row of what else is needed."""
        t = self.trees
        owner = np.searchsorted(t.roots, np.arange(len(t.left)), side="right") - 1
        rows = pd.DataFrame({"tree": owner, "node": np.arange(len(t.left)), "feature": t.feature, "threshold": t.threshold,
                             "missing_left": t.missing_left, "left": t.left, "right": t.right, "value": t.value, "cover": t.cover})
        spark = SparkSession.active()
        spark.createDataFrame(rows, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.name, self.features, float(t.base), json.dumps(self.spec))],
                              "name string, features array<string>, base double, spec string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TreeModel":
        m = spark.read.parquet(f"{path}/model").first()
        t = spark.read.schema(_NODES).parquet(f"{path}/nodes").toPandas().sort_values("node")
        roots = t.groupby("tree")["node"].min().to_numpy(dtype=np.int64)
        col = {c: t[c].to_numpy() for c in t.columns}
        flat = FlatTrees(m["base"], roots, col["feature"], col["threshold"], col["missing_left"].astype(bool),
                         col["left"].astype(np.int64), col["right"].astype(np.int64), col["value"], col["cover"])
        return TreeModel(m["name"], list(m["features"]), flat, json.loads(m["spec"]))


def fit_trees(train: DataFrame, name: str, spec: BoostSpec | ForestSpec, target: str,
              features: list[str] = FEATURES) -> TreeModel:
    """Fit one ensemble on the rows of ``train`` that have a target."""
    data = bin_rows(train, target, features, spec.max_bins)
    try:
        trees = fit_boosting(data, spec) if isinstance(spec, BoostSpec) else fit_forest(data, spec)
    finally:
        data.blocks.unpersist()
    return TreeModel(name, list(features), trees, asdict(spec))
