"""Near-duplicate documents by Order MinHash.

A document is its sequence of five-word shingles, each labelled with its occurrence
number.  Every sketch takes the ``PICK`` shingles with the smallest hashes under its
own hash function and keeps them in text order, so equal sketches tell of equal
content in equal order.  Similarity is ``1 - d / max(n, m)`` with ``d`` the edit
distance of the two shingle sequences, verified by banded alignment; documents are
linked from 0.8 on.

Texts with equal word sequences are collapsed first.  A bucket of equal sketches
gives one candidate pair per member (with the smallest member); only buckets that
still hold several components afterwards are searched pair by pair, in groups of
bounded size, and only for pairs that cross components.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.buckets import block_pairs
from airgrid.llm.common import giving_back, stored, widest
from airgrid.llm.graph import components
from airgrid.llm.words import gram_hashes, mix, occurrence, word_hashes

SHINGLE, PICK, SKETCHES, SLOTS, SIMILARITY, BLOCK = 5, 2, 20, 256, 0.8, 2048
ERRORS = 4.5                        # standard errors that a signature may stay below the bound
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, size=SKETCHES, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 14
_ROWS = 64


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled shingle hashes in text order; fewer than ``k`` words are one shingle."""
    return _shingles(word_hashes(text), k)


def _shingles(w: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    g = gram_hashes(w, min(k, len(w))) if len(w) else np.empty(0, np.uint64)
    return mix(g + occurrence(g).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def digest(text: str | None) -> bytes:
    """Equal for equal word sequences; wordless texts are compared as they are."""
    return _digest(word_hashes(text), text)


def _digest(w: np.ndarray, text: str | None) -> bytes:
    return hashlib.blake2b(w.tobytes() if len(w) else (text or "").encode("utf-8", "surrogatepass"),
                           digest_size=16, person=b"words" if len(w) else b"raw").digest()


def shared(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """At least the number of common shingles of sequences of n and m, from their different 16-bit hashes."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) + min(n - len(a), m - len(b))


def sketch(s: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """(order-minhash keys, signature of SLOTS bytes, different 16-bit shingle hashes in order).

    The signature deals the shingles into SLOTS bins by one hash and keeps a byte of the
    smallest hash in each bin, 0 for an empty bin.
    """
    n = len(s)
    take = min(PICK, n)
    best = np.full((len(_SEEDS), take), np.iinfo(np.uint64).max, dtype=np.uint64)
    place = np.zeros((len(_SEEDS), take), dtype=np.int64)
    rows = np.arange(len(_SEEDS))[:, None]
    for at in range(0, n, _CHUNK):
        h = s[None, at:at + _CHUNK] * _SEEDS[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        p = np.zeros((len(_SEEDS), min(take, h.shape[1])), dtype=np.int64)
        least = np.empty(p.shape, dtype=np.uint64)
        for j in range(p.shape[1]):                          # a partition is far slower for so few
            p[:, j] = h.argmin(axis=1)
            least[:, j] = h[rows[:, 0], p[:, j]]
            h[rows[:, 0], p[:, j]] = np.iinfo(np.uint64).max
        both = np.concatenate([best, least], axis=1)
        where = np.concatenate([place, p + at], axis=1)
        o = np.argsort(both, axis=1, kind="stable")[:, :take]
        best, place = both[rows, o], where[rows, o]
    order = np.sort(place, axis=1)
    key = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(take):
        key = mix(key ^ s[order[:, j]])
    h = np.sort(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    top = (h >> np.uint64(56)).astype(np.int64)              # 256 bins by the top byte
    first = np.flatnonzero(np.diff(top, prepend=-1))
    bins = top[first]
    sig = np.zeros(SLOTS, dtype=np.uint8)
    sig[bins] = 1 + (h[first] >> np.uint64(20)) % np.uint64(254)       # 255 stays free
    small = np.sort((s >> np.uint64(24)).astype(np.uint16), kind="stable")
    return key, sig.tobytes(), small[np.append(True, small[1:] != small[:-1])].tobytes()


# ---- verification --------------------------------------------------------------

def _increasing(seq: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing subsequence."""
    if len(seq) < 2 or (np.diff(seq) > 0).all():
        return np.arange(len(seq))
    tails, tail_at, back = [], [], []
    for i, v in enumerate(seq.tolist()):
        j = bisect_left(tails, v)
        back.append(tail_at[j - 1] if j else -1)
        if j == len(tails):
            tails.append(v)
            tail_at.append(i)
        else:
            tails[j], tail_at[j] = v, i
    out, i = [], tail_at[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two sequences, or ``limit + 1`` if it is larger (band of width 2 limit + 1)."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if len(a) > len(b):
        a, b = b, a
    n, m, far = len(a), len(b), limit + 1
    width = 2 * limit + 1
    step = np.arange(width)
    cols = step - limit                                      # row i holds columns i - limit .. i + limit
    row = np.where(cols >= 0, np.minimum(cols, far), far)
    row[cols > m] = far
    pad = np.zeros(limit + 1, dtype=b.dtype)
    padded = np.concatenate([pad, b, pad])
    for i in range(1, n + 1):
        c = i + cols
        inside = (c >= 1) & (c <= m)
        lo = i - limit - 1 + limit + 1                       # index of b[i - limit - 1] in ``padded``
        same = (padded[lo:lo + width] == a[i - 1]) & inside
        new = np.where(inside, row + ~same, far)             # diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)         # from above
        new[c < 0] = far
        new[c > m] = far
        if 0 <= limit - i < width:
            new[limit - i] = min(i, far)                     # column 0
        new = np.minimum.accumulate(new - step) + step       # along the row
        row = np.minimum(new, far)
        row[(c < 0) | (c > m)] = far
        if row.min() >= far:
            return far
    return int(min(row[limit + m - n], far))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether ``1 - distance / max(n, m)`` reaches the similarity."""
    n, m = len(a), len(b)
    top = max(n, m)
    if not top:
        return n == m
    limit = int(np.floor((1 - similarity) * top + 1e-9))
    _, pa, pb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if top - len(pa) > limit:                                # every shingle without a partner costs one edit
        return False
    o = np.argsort(pa)
    pa, pb = pa[o], pb[o]
    chain = _increasing(pb)
    # Editing only between the chain's shingles is one way, so its cost bounds the distance.
    ga = np.diff(np.concatenate([[-1], pa[chain], [n]])) - 1
    gb = np.diff(np.concatenate([[-1], pb[chain], [m]])) - 1
    if int(np.maximum(ga, gb).sum()) <= limit:
        return True
    if top - len(chain) > limit:                             # too few partners can be kept in order
        return False
    return banded_distance(a, b, limit) <= limit


# ---- operator ------------------------------------------------------------------

def _facts(text: str | None) -> tuple[bytes, int, np.ndarray, bytes, bytes]:
    """(digest, number of shingles, keys, signature, short hashes) from one splitting of the text."""
    w = word_hashes(text)
    s = _shingles(w)
    keys, sig, small = sketch(s) if len(s) else (np.empty(0, np.uint64), b"", b"")
    return _digest(w, text), len(s), keys.view(np.int64), sig, small


def _sketches(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f["doc_id"], f["text"], strict=True):
                out.append((i, *_facts(t)))
            made = pd.DataFrame(out, columns=["doc_id", "digest", "n", "keys", "sig", "small"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made
    return docs.mapInPandas(giving_back(run), "doc_id long, digest binary, n long, keys array<long>, sig binary, small binary")


def may_be_similar(match: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether signatures allow the similarity for sequences of n and m shingles.

    A pair at the similarity shares ``c >= similarity * max(n, m)`` of its ``u = n + m - c``
    different shingles.  The smallest hashes of the ``filled`` bins are a random draw of
    that many from the u, so matches follow a hypergeometric law; pairs more than ERRORS
    standard errors below its mean are left out.  Lengths are tested exactly.
    """
    top, low = np.maximum(n, m), np.minimum(n, m)
    c = similarity * top
    u = np.maximum(n + m - c, 1.0)
    j = np.minimum(c / u, 1.0)
    spread = np.sqrt(filled * j * (1 - j) * np.clip((u - filled) / np.maximum(u - 1, 1), 0, 1))
    return (low >= c - 1e-9) & (match >= filled * j - ERRORS * spread - 1.0)


def signature_matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal filled bins, and bins filled in either, of every left with every right signature."""
    a, b = np.ascontiguousarray(left.T), np.ascontiguousarray(np.where(right > 0, right, 255).T)
    match = np.zeros((left.shape[0], right.shape[0]), dtype=np.uint16)
    for c in range(left.shape[1]):
        match += a[c][:, None] == b[c][None, :]
    ha, hb = (left > 0).astype(np.float32), (right > 0).astype(np.float32)
    filled = ha.sum(1)[:, None] + hb.sum(1)[None, :] - ha @ hb.T
    return match, filled


def _may_be_similar(similarity: float):
    def run(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        match, filled = ((x == y) & (x > 0)).sum(axis=1), ((x | y) > 0).sum(axis=1)
        return pd.Series(may_be_similar(match, filled, n.to_numpy(), m.to_numpy(), similarity))
    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "n": pd.Series, "m": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    known = need.join(reps.select("node", "doc_id", F.col("digest").alias("_digest")), "node")

    @F.pandas_udf("boolean")
    def is_text(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([digest(t) == bytes(d) for t, d in zip(texts, own, strict=True)], dtype=bool)

    texts = (docs.join(known, "doc_id").where(is_text("text", "_digest"))
             .select("node", "text").dropDuplicates(["node"]))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in held:
                if len(held) >= 256:
                    held.clear()
                held[node] = shingles(text)
            return held[node]
        for f in frames:
            ok = [similar(of(a, x), of(b, y), similarity) for a, b, x, y in
                  zip(f["a"], f["b"], f["ta"], f["tb"], strict=True)]
            yield f.loc[ok, ["a", "b"]]

    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInPandas(giving_back(run), "a long, b long")


def _cross_pairs(buckets: DataFrame, reps: DataFrame, similarity: float, most: int | None, block: int) -> DataFrame:
    """Pairs of different components that share a bucket and look similar by signature.

    Signatures leave out most pairs; of the others the number of common shingles is
    bounded from above by their 16-bit hashes, which only leaves out pairs that cannot
    be similar.  For each node of a group the ``most`` best pairs (all if None); a group
    that holds some back adds the pair (0, 0).
    """
    facts = reps.select("node", "n", "sig", "small", "keys")
    groups = (block_pairs(buckets, ["key"], F.col("node"), block).join(facts, "node")
              .select("key", "band", "_i", "_j", "_side", "node", "comp", "n", "sig", "small", "keys"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(len(f), -1)
        n, node, comp, side = (f[c].to_numpy() for c in ("n", "node", "comp", "_side"))
        keys, band = np.stack(f["keys"].to_numpy()), int(f["band"].iloc[0])
        sets = [np.frombuffer(s, np.uint16) for s in f["small"]]
        two = f["_i"].iloc[0] != f["_j"].iloc[0]
        # Members of the largest component need no comparison with each other: the rest meet all.
        names, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(inverse != sizes.argmax())
        found = []
        for k in range(0, len(rest), _ROWS):
            r = rest[k:k + _ROWS]
            match, filled = signature_matches(x[r], x)
            ok = may_be_similar(match, filled, n[r][:, None], n[None, :], similarity) & (comp[r][:, None] != comp[None, :])
            if two:
                ok &= side[r][:, None] != side[None, :]
            i, b = np.nonzero(ok)
            a = r[i]
            # Each pair once: in the first band it shares (an unmixed bucket before has it in one component).
            once = ~(keys[a, :band] == keys[b, :band]).any(axis=1) & ((a < b) | (inverse[b] == sizes.argmax()))
            a, b = a[once], b[once]
            common = np.array([shared(sets[p], sets[q], n[p], n[q]) for p, q in zip(a, b, strict=True)], dtype=np.int64)
            enough = common >= similarity * np.maximum(n[a], n[b]) - 1e-9
            found.append((a[enough], b[enough], common[enough]))
        a, b, common = (np.concatenate(v) if found else np.empty(0, np.int64) for v in (zip(*found) if found else [[]] * 3))
        full = True
        if most is not None and len(a):
            o = np.lexsort((node[b], -common, a))
            a, b = a[o], b[o]
            new = np.concatenate([[True], a[1:] != a[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            use = np.arange(len(a)) - first < most
            full = use.all()
            a, b = a[use], b[use]
        out = pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])}).drop_duplicates()
        return out if full else pd.concat([out, pd.DataFrame({"a": [0], "b": [0]})])

    # A fixed count: what a group costs follows its pairs, not the bytes that coalescing goes by.
    groups = groups.repartition(4 * widest(groups), "key", "_i", "_j")
    return groups.groupBy("key", "_i", "_j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, digest, class_id and kept (doc_id = class_id) for each row of ``docs``.

    ``class_id`` is the smallest id among the documents linked to the row's.  Null and
    empty texts are equal; wordless texts only link with equal ones; texts of fewer than
    five words only with equal word sequences.  Rows without an id join the class of
    their text; a class without any id has a null class.  Repeated rows are classed
    alike; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = stored(_sketches(base), "omh-sketches")
    reps = stored(made.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"),
                                             F.min_by(F.struct("n", "keys", "sig", "small"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("s"))
                  .select(F.xxhash64("doc_id", "digest").alias("node"), "digest", "doc_id", "copies", "s.*"), "omh-classes")
    spread = reps.where("doc_id is not null").select("node", F.posexplode("keys").alias("band", "key"))
    hubs = spread.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    buckets = stored(spread.join(hubs, "key"), "omh-buckets")
    facts = reps.select("node", "n", "sig")
    pairs = buckets.where("a < node").select("a", F.col("node").alias("b")).distinct()
    fa = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    fb = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    close = (pairs.join(fb, "b").join(fa, "a").where(_may_be_similar(similarity)("sa", "sb", "na", "nb"))
             .select("a", "b"))
    tried = stored(close, "omh-pairs")
    edges = stored(_verify(tried, reps, base, similarity), "omh-links")
    comp = components(edges, "a", "b")
    for most in (32, None):
        comp = stored(comp, "omh-components")
        named = buckets.select("key", "band", "node").join(comp, "node", "left").select(
            "key", "band", "node", F.coalesce("component", "node").alias("comp"))
        # The one pair of a bucket of two was tested as a hub pair already.
        mixed = (named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
                 .where("lo < hi and n > 2").select("key"))
        cand = _cross_pairs(named.join(mixed, "key"), reps, similarity, most, block)
        cand = stored(cand.join(tried, ["a", "b"], "left_anti"), "omh-pairs")
        held_back, cand = not cand.where("a = b").isEmpty(), cand.where("a <> b")
        if not cand.isEmpty():
            more = stored(_verify(cand, reps, base, similarity), "omh-links")
            tried, edges = tried.unionByName(cand), edges.unionByName(more)
            comp = components(edges, "a", "b")
        if not held_back:
            break
    classes = reps.select("node", "digest", "doc_id").join(comp, "node", "left").select(
        "digest", "doc_id", F.coalesce("component", "node").alias("comp"))
    first = classes.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    final = classes.join(first, "comp").select("digest", "class_id")
    return (made.select("doc_id", "digest").join(final, "digest")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, once.

    Documents without an id stay when no document of their class has one, one per text.
    """
    keep = (near_duplicates(docs, id_col, text_col, similarity).where("kept")
            .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct())

    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t) for t in texts], dtype=object)

    own = docs.withColumns({"_own": digests(F.col(text_col))})
    return (own.join(keep, own[id_col].eqNullSafe(keep["_id"]) & (own["_own"] == keep["_digest"]), "left_semi")
            .dropDuplicates([id_col, "_own"]).drop("_own"))
