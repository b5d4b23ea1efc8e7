"""Embedding near-duplicates by random-hyperplane sign hashing.

Equal vectors are first collapsed to one representative.  Every representative
gets one key per table: the sides of ``bits`` random hyperplanes.  Vectors that
share a key in some table are compared exactly (cosine in double precision) inside
that bucket's groups, each pair in the first table it shares.  Groups return one
count per vector and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.buckets import block_pairs
from airgrid.llm.common import stored, widest
from airgrid.llm.graph import components

COSINE, MISS, TARGET_BUCKET, BLOCK = 0.98, 1e-6, 1024, 1024
_SIGN = -(1 << 63)


def plan_tables(n: int, cosine: float = COSINE, miss: float = MISS, target: int = TARGET_BUCKET) -> tuple[int, int]:
    """(bits, tables): buckets of about ``target`` vectors of the largest label, and enough
    tables that a pair exactly at ``cosine`` is missed with probability ``miss`` at most."""
    bits = int(min(40, max(2, math.ceil(math.log2(max(1, n) / target)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - together)))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs (a, b) for each of ``n`` indices."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE, miss: float = MISS,
                    target: int = TARGET_BUCKET, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept and usable per row of ``vectors``.

    Only equal non-null labels and equal dimensions are compared.  Null, empty and
    zero vectors and those with null or non-finite components link with nothing, as
    do rows without an id (their component is null and they are not kept).  Rows
    that repeat an id with another vector are vectors of their own, each with its own
    links and component; a component's id is the smallest vec_id in it.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                       F.col(label_col).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite
              & F.exists("v", lambda x: x != 0))
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Equal vectors meet by digest of label and components; a scale does not matter here.
    v = v.withColumn("digest", F.when(F.col("usable"), F.sha2(F.concat_ws(":", "label", F.col("v").cast("string")), 256)))
    members = v.select("vec_id", "usable", "digest")
    # A vector's node sorts by its smallest id; the digest keeps vectors that share an id apart.
    node = F.concat(F.lpad(F.hex(F.col("rep").bitwiseXOR(F.lit(_SIGN))), 16, "0"), F.substring("digest", 1, 16))
    body = stored(v.where("usable").groupBy("digest")
                  .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                       F.min_by(F.struct("label", "v"), "vec_id").alias("s"))
                  .select("digest", node.alias("node"), "copies", "s.label", "s.v"), "vectors")
    rank = body.select("digest", "node", "copies")
    largest = body.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, cosine, miss, target)

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(bits)).astype(np.int64)
        for f in frames:
            for dim, part in f.groupby(f["v"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)            # no overflow or underflow in the norm
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                side = (x @ planes[dim] > 0).reshape(len(x), tables, bits).astype(np.int64)
                key = (side * weight).sum(axis=2)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "copies": part["copies"].to_numpy(),
                                    "space": [f"{dim}:{s}" for s in part["label"]],
                                    "unit": [r.tobytes() for r in x], "keys": list(key)})

    hashed = body.mapInPandas(keys, "node string, copies long, space string, unit binary, keys array<long>")
    spread = hashed.select("node", "copies", "space", "unit", "keys", F.posexplode("keys").alias("t", "key"))
    groups = block_pairs(spread, ["space", "t", "key"], F.col("node"), block)

    # A fixed count: what a group costs follows its pairs, not the bytes that coalescing goes by.
    groups = groups.repartition(4 * widest(groups), "space", "t", "key", "_i", "_j")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(f["unit"]), dtype=np.float64).reshape(len(f), -1)
        key = np.stack(f["keys"].to_numpy())
        t, copies, node = int(f["t"].iloc[0]), f["copies"].to_numpy(), f["node"].to_numpy().astype(str)
        side = f["_side"].to_numpy()
        near = (x @ x.T) >= cosine
        if f["_i"].iloc[0] != f["_j"].iloc[0]:
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        first = ~(key[a, :t] == key[b, :t]).any(axis=1) if t else np.ones(len(a), bool)
        a, b = a[first], b[first]
        links = np.bincount(a, copies[b], len(f)) + np.bincount(b, copies[a], len(f))
        root = node[local_components_by_value(node, a, b)]
        keep = (links > 0) | (root != node)
        return pd.DataFrame({"node": node[keep], "links": links[keep].astype(np.int64), "root": root[keep]})

    found = stored(groups.groupBy("space", "t", "key", "_i", "_j")
                   .applyInPandas(compare, "node string, links long, root string"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.where("root <> node"), "node", "root", "string")
    smallest = F.conv(F.substring(F.coalesce("component", "node"), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    classes = (rank.join(links, "node", "left").join(comps, "node", "left")
               .select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       smallest.alias("component_id")))
    return (members.join(classes, "digest", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"), "usable")
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def local_components_by_value(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each index, the index of the smallest value reachable by the pairs (a, b)."""
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.arange(len(values))
    return order[local_components(len(values), place[a], place[b])[place]]
