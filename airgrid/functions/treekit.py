"""Regression trees on bin codes in numpy: split search, best-first growth, scoring, attributions.

Everything here works on bounded arrays: histograms of (feature, bin), the rows of one
small node, or one Arrow batch.  ``operators.trees`` supplies histograms and rows from
the distributed training data.  Splits are second order: with gradient sum G and
hessian sum H a leaf is worth -G / (H + l2), and a split gains the rise of
G**2 / (H + l2).  Plain means are the case gradient = -y, hessian = weight.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

BINS = 256                   # codes of a feature; the last one stands for a missing value
MISSING = BINS - 1
_SHORT = 512                 # rows of a node whose histogram is not kept
_CELLS = 1 << 21             # numbers of one array while scoring or explaining


@dataclass(frozen=True)
class GrowthLimits:
    max_depth: int | None = None
    max_leaves: int | None = None
    min_leaf: int = 1                # rows
    min_split: int = 2               # rows
    min_weight: float = 0.0          # hessian of a leaf
    l2: float = 0.0


@dataclass
class Node:
    depth: int
    n: int
    g: float
    h: float
    hist: np.ndarray | None = None           # (features, BINS, 3): gradient, hessian, rows
    rows: tuple | None = None                # (codes, gradient, hessian) of a small node
    split: tuple | None = None               # gain, feature, bin, missing goes left, left n, g, h
    kids: tuple["Node", "Node"] | None = None
    attached: bool = False                   # the split is part of the tree
    known: bool = False                      # the split, if there is one, was found elsewhere
    limits: GrowthLimits | None = None


def rows_limit(features: int) -> int:
    """Rows that take no more room than a histogram; a smaller node travels as rows."""
    return features * BINS * 24 // (features + 16)


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    n, width = codes.shape
    at = (codes + np.arange(width, dtype=np.int64) * BINS).ravel()
    out = np.empty((width * BINS, 3))
    out[:, 0] = np.bincount(at, np.repeat(g, width), width * BINS)
    out[:, 2] = np.bincount(at, minlength=width * BINS)
    same = h is None or (n and h[0] == 1.0 and not (h != 1.0).any())
    out[:, 1] = out[:, 2] if same or not n else np.bincount(at, np.repeat(h, width), width * BINS)
    return out.reshape(width, BINS, 3)


def best_split(hist: np.ndarray, g: float, h: float, n: int, lim: GrowthLimits, allowed: np.ndarray | None = None):
    """(gain, feature, bin, missing goes left, left n, left g, left h) or None.

    Rows with code <= bin go left.  Both sides are tried for missing values; without
    any in the node they go to the larger child.  Ties take the first feature, bin, side.
    """
    given = np.arange(len(hist)) if allowed is None else np.flatnonzero(allowed)
    hist = hist if allowed is None else hist[given]
    lost = hist[:, MISSING]
    has_missing = lost[:, 2].any()
    bins = min(MISSING, int(np.flatnonzero(hist[:, :MISSING, 2].any(axis=0)).max(initial=0)) + 1)
    below = np.cumsum(hist[:, :bins], axis=1)
    sides = [below, below + lost[:, None, :]] if has_missing else [below]
    best = None
    whole = g * g / (h + lim.l2) if h + lim.l2 > 0 else 0.0
    for side, left in enumerate(sides):
        gl, hl, nl = left[..., 0], left[..., 1], left[..., 2]
        hr, nr = h - hl, n - nl
        ok = (nl >= lim.min_leaf) & (nr >= lim.min_leaf) & (nl > 0) & (nr > 0)
        if lim.min_weight > 0:
            ok &= (hl >= lim.min_weight) & (hr >= lim.min_weight)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, gl * gl / (hl + lim.l2) + (g - gl) ** 2 / (hr + lim.l2) - whole, -np.inf)
        f, b = divmod(int(gain.argmax()), bins)
        top = float(gain[f, b])
        if top > 1e-12 * max(1.0, abs(whole)) and (best is None or top > best[0]):
            to_left = bool(side) if lost[f, 2] > 0 else bool(nl[f, b] >= nr[f, b])
            best = (top, int(given[f]), b, to_left, int(nl[f, b]), float(gl[f, b]), float(hl[f, b]))
    return best


def goes_left(codes: np.ndarray, b, missing_left) -> np.ndarray:
    return np.where(codes == MISSING, missing_left, codes <= b)


def _children(node: Node) -> tuple[Node, Node]:
    _, _, _, _, nl, gl, hl = node.split
    return (Node(node.depth + 1, nl, gl, hl), Node(node.depth + 1, node.n - nl, node.g - gl, node.h - hl))


def _split_rows(node: Node) -> None:
    codes, g, h = node.rows
    _, f, b, to_left, *_ = node.split
    left = goes_left(codes[:, f], b, to_left)
    node.kids = _children(node)
    for kid, part in zip(node.kids, (left, ~left), strict=True):
        kid.rows = (codes[part], g[part], None if h is None else h[part])
    small, large = sorted(node.kids, key=lambda k: k.n)
    if node.hist is not None and _splittable(large, node.limits):
        small.hist = histogram(*small.rows)
        large.hist = node.hist - small.hist


def _splittable(node: Node, lim: GrowthLimits) -> bool:
    return (node.n >= max(lim.min_split, 2 * lim.min_leaf)
            and (lim.max_depth is None or node.depth < lim.max_depth))


def _evaluate(node: Node, lim: GrowthLimits, allowed) -> None:
    if node.known:
        return
    node.limits = lim
    if _splittable(node, lim):
        if node.hist is None:
            node.hist = histogram(*node.rows)
        node.split = best_split(node.hist, node.g, node.h, node.n, lim, allowed)
    if node.split is None:
        node.hist = node.rows = None
    elif node.rows is not None and node.n <= _SHORT:
        node.hist = None                     # made anew from few rows, so that open nodes stay small


def best(node: Node, lim: GrowthLimits, allowed: np.ndarray | None = None):
    """The best split of a node within the limits, or None."""
    _evaluate(node, lim, allowed)
    return node.split


def grow(root: Node, lim: GrowthLimits, allowed: np.ndarray | None = None,
         fetch: Callable[[Node, list[Node], int | None], None] | None = None, ahead: int = 16) -> Node:
    """Best-first growth: the open leaf with the largest gain is split next.

    Children of a node that is held as rows are made here.  ``fetch(root, nodes, left)``
    gives splits to the children of all other nodes; it is called for the best leaf and
    up to ``ahead`` of the next best ones at once, ``left`` tells how many leaves may
    still be split, and what it brings for a leaf that is never split is not used.  A
    node's split depends on its own rows only, so the tree is the one that single steps
    would give.
    """
    _evaluate(root, lim, allowed)
    order, heap, leaves = 0, [], 1
    if root.split:
        heap.append((-root.split[0], 0, root))
    while heap and (lim.max_leaves is None or leaves < lim.max_leaves):
        node = heapq.heappop(heap)[2]
        if node.kids is None:
            if node.rows is not None:
                _split_rows(node)
            else:
                left = len(heap) if lim.max_leaves is None else lim.max_leaves - leaves - 1
                more = [x for _, _, x in heapq.nsmallest(min(ahead, left), heap) if x.kids is None and x.rows is None]
                wanted = [node, *more]
                for x in wanted:
                    x.kids = _children(x)
                fetch(root, wanted, None if lim.max_leaves is None else lim.max_leaves - leaves)
        node.attached = True
        leaves += 1
        for kid in node.kids:
            _evaluate(kid, lim, allowed)
            if kid.split:
                order += 1
                heapq.heappush(heap, (-kid.split[0], order, kid))
        node.hist = node.rows = None
    return root


def found_splits(root: Node) -> list[tuple | None]:
    """The splits of a grown tree in breadth-first order, None for a leaf."""
    nodes, out = [root], []
    for x in nodes:
        out.append(x.split if x.attached else None)
        if x.attached:
            nodes.extend(x.kids)
    return out


def hang(root: Node, splits: list[tuple | None]) -> None:
    """Put splits that were found elsewhere under ``root``; growth attaches them in its own order.

    One growth with as many leaves as may still be split holds every split that the
    whole tree can take from here, as both take the largest gain first.
    """
    nodes = [root]
    for x, split in zip(nodes, splits):                      # grows while it is read
        x.known, x.split = True, split
        if split is not None:
            x.kids = _children(x)
            nodes.extend(x.kids)


# ------------------------------------------------------------------ flat trees --

_KINDS = {"feature": np.int32, "bin": np.int32, "missing_left": bool, "left": np.int32, "right": np.int32,
          "value": np.float64, "cover": np.float64}


def flatten(root: Node, value: Callable[[Node], float], known: bool = False) -> dict[str, np.ndarray]:
    """Arrays of a tree in breadth-first order; leaves have ``left`` -1.

    With ``known`` splits that are not attached yet count too (to route rows to them).
    """
    nodes, i = [root], 0
    left = []
    while i < len(nodes):
        x = nodes[i]
        inner = x.kids is not None and (x.attached or known)
        left.append(len(nodes) if inner else -1)
        if inner:
            nodes.extend(x.kids)
        i += 1
    left = np.array(left, np.int32)
    s = [x.split if a >= 0 else (0, 0, 0, False) for x, a in zip(nodes, left, strict=True)]
    return {"feature": np.array([t[1] for t in s], np.int32), "bin": np.array([t[2] for t in s], np.int32),
            "missing_left": np.array([t[3] for t in s], bool), "left": left, "right": np.where(left >= 0, left + 1, -1).astype(np.int32),
            "value": np.array([value(x) if a < 0 else 0.0 for x, a in zip(nodes, left, strict=True)]),
            "cover": np.array([x.h for x in nodes]), "nodes": nodes}


def pack(tree: dict) -> bytes:
    """A tree in breadth-first order in few bytes: what inner nodes and leaves need, each once.

    Children follow from the order, and covers of inner nodes are the sums of their leaves'
    where covers are counts.
    """
    inner = tree["left"] >= 0
    cover = tree["cover"]
    counts = bool((cover == np.rint(cover)).all() and (cover >= 0).all() and cover.sum() < 2 ** 53)
    kept = cover[~inner] if counts else cover
    if counts:
        kept = kept.astype(np.min_scalar_type(int(kept.max(initial=0))))
    feature = tree["feature"][inner]
    return pickle.dumps((len(inner), np.packbits(inner), feature.astype(np.min_scalar_type(int(feature.max(initial=0)))),
                         tree["bin"][inner].astype(np.uint8), np.packbits(tree["missing_left"][inner]),
                         tree["value"][~inner], counts, kept), protocol=5)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    n, bits, feature, cut, lost, value, counts, kept = pickle.loads(data)
    inner = np.unpackbits(bits, count=n).astype(bool)
    out = {k: np.zeros(n, kind) for k, kind in _KINDS.items()}
    out["feature"][inner], out["bin"][inner] = feature, cut
    out["missing_left"][inner] = np.unpackbits(lost, count=int(inner.sum())).astype(bool)
    out["left"][:] = np.where(inner, 2 * np.cumsum(inner) - 1, -1)
    out["right"][:] = np.where(inner, out["left"] + 1, -1)
    out["value"][~inner] = value
    if counts:
        out["cover"][~inner] = kept
        levels, lo, hi = [], 0, 1
        while lo < hi:
            levels.append(lo + np.flatnonzero(inner[lo:hi]))
            lo, hi = hi, hi + 2 * len(levels[-1])
        for at in reversed(levels):
            out["cover"][at] = out["cover"][out["left"][at]] + out["cover"][out["right"][at]]
    else:
        out["cover"][:] = kept
    return out


def leaf_of(tree: dict, codes: np.ndarray) -> np.ndarray:
    """Index of the leaf that each row of bin codes reaches."""
    at = np.zeros(len(codes), np.int64)
    row = np.arange(len(codes))
    while True:
        inner = tree["left"][at] >= 0
        if not inner.any():
            return at
        i, a = row[inner], at[inner]
        go = goes_left(codes[i, tree["feature"][a]], tree["bin"][a], tree["missing_left"][a])
        at[inner] = np.where(go, tree["left"][a], tree["right"][a])


@dataclass
class FlatTrees:
    """An ensemble as node arrays: prediction = ``base`` + sum of the leaves reached."""
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray            # x <= threshold goes left
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    _paths: list | None = field(default=None, repr=False)

    @staticmethod
    def join(base: float, trees: list[dict], edges: list[np.ndarray], scale: float = 1.0) -> "FlatTrees":
        sizes = np.array([len(t["left"]) for t in trees], np.int64)
        roots = np.cumsum(sizes) - sizes
        cat = {k: np.concatenate([t[k] for t in trees]) if trees else np.empty(0, kind) for k, kind in _KINDS.items()}
        shift = np.repeat(roots, sizes)
        inner = cat["left"] >= 0
        threshold = np.zeros(len(inner))
        for f in np.unique(cat["feature"][inner]):
            at = inner & (cat["feature"] == f)
            # beyond the last edge only missing values go right
            threshold[at] = np.append(edges[f], np.inf)[np.minimum(cat["bin"][at], len(edges[f]))]
        return FlatTrees(base, roots, cat["feature"], threshold, cat["missing_left"], np.where(inner, cat["left"] + shift, -1),
                         np.where(inner, cat["right"] + shift, -1), cat["value"] * scale, cat["cover"])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees for a float matrix; NaN is a missing value."""
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        step = max(1, _CELLS // len(self.roots))
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            row = np.broadcast_to(np.arange(len(part))[:, None], at.shape)
            while True:
                inner = self.left[at] >= 0
                if not inner.any():
                    break
                a = at[inner]
                v = part[row[inner], self.feature[a]]
                go = np.where(np.isnan(v), self.missing_left[a], v <= self.threshold[a])
                at[inner] = np.where(go, self.left[a], self.right[a])
            out[lo:lo + step] += self.value[at].sum(axis=1)
        return out

    # -------------------------------------------------------------- attributions --

    def _leaf_paths(self) -> list[tuple]:
        """Per tree: leaf values, and per leaf and distinct feature the cover share and the interval it asks for."""
        if self._paths is None:
            self._paths = [self._tree_paths(int(r)) for r in self.roots]
        return self._paths

    def _tree_paths(self, root: int) -> tuple:
        leaves, stack = [], [(root, {})]
        while stack:
            i, path = stack.pop()
            if self.left[i] < 0:
                leaves.append((self.value[i], path))
                continue
            f, thr, ml = int(self.feature[i]), float(self.threshold[i]), bool(self.missing_left[i])
            for kid, is_left in ((int(self.left[i]), True), (int(self.right[i]), False)):
                z, lo, hi, lost = path.get(f, (1.0, -np.inf, np.inf, True))
                share = z * self.cover[kid] / self.cover[i]
                stack.append((kid, {**path, f: (share, lo, min(hi, thr), lost and ml) if is_left
                                    else (share, max(lo, thr), hi, lost and not ml)}))
        width = max(1, max(len(p) for _, p in leaves))
        n = len(leaves)
        f, z = np.zeros((n, width), np.int64), np.ones((n, width))
        lo, hi, lost = np.full((n, width), -np.inf), np.full((n, width), np.inf), np.ones((n, width), bool)
        for i, (_, p) in enumerate(leaves):
            for j, (k, (share, a, b, m)) in enumerate(p.items()):
                f[i, j], z[i, j], lo[i, j], hi[i, j], lost[i, j] = k, share, a, b, m
        used = np.array([len(p) for _, p in leaves])
        return np.array([v for v, _ in leaves]), f, z, lo, hi, lost, np.arange(width)[None, :] < used[:, None]

    def attributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Exact Shapley values of every row and feature, and the value of knowing no feature.

        The game of a tree: an unknown feature sends a row down both branches with the
        shares of their training covers.  A leaf is then a product over its path's
        distinct features of o (the row satisfies them) or z (their shares), and the
        Shapley value of feature i is the integral over t in 0..1 of
        (o_i - z_i) * prod_{j != i} ((1 - t) z_j + t o_j), a polynomial in t that
        Gauss-Legendre points integrate exactly.
        """
        n, width = x.shape
        phi, empty = np.zeros((n, width)), self.base
        for value, f, z, lo, hi, lost, real in self._leaf_paths():
            empty += float((value * z.prod(axis=1)).sum())
            deep = f.shape[1]
            t, w = np.polynomial.legendre.leggauss(-(-deep // 2))
            t, w = (t + 1) / 2, w / 2
            place = np.zeros((f.size, width))
            place[np.arange(f.size)[real.ravel()], f[real]] = 1.0
            step = max(1, _CELLS // f.size)
            for at in range(0, n, step):
                v = x[at:at + step][:, f]                                       # rows, leaves, path
                with np.errstate(invalid="ignore"):
                    o = np.where(np.isnan(v), lost, (v > lo) & (v <= hi)).astype(float)
                o = np.where(real, o, 1.0)
                each = np.zeros_like(o)
                for q, weight in zip(t, w, strict=True):
                    term = z * (1 - q) + o * q
                    each += weight * (term.prod(axis=2, keepdims=True) / term)
                each *= (o - z) * value[None, :, None]
                phi[at:at + step] += each.reshape(len(v), -1) @ place
        return phi, empty


def bin_codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Codes of a float matrix: how many edges lie below a value; NaN is MISSING."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], side="left"))
    return out


def draw(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Uniform numbers in 0..1 by row id, seed and tree: the same wherever and whenever a row is read."""
    x = ids ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2 ** 64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


_POISSON = np.cumsum([1 / np.e / np.prod(np.arange(1, k + 1)) for k in range(17)])


def bootstrap(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap: Poisson with mean one."""
    return np.searchsorted(_POISSON, draw(ids, seed, tree), side="right").astype(float)
