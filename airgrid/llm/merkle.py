"""Merkle manifest of a dataset: digests, inclusion proofs and their verification.

Texts are read once: only leaf digests travel.  Leaves get a position inside their
group from a range sort and small offset counts, so no group lies in one task.  Trees
are built over (group, block of ``fan ** LEVELS`` positions): inside a block every
level reads its siblings with lag and lead at fixed offsets (a node is represented by
its first leaf, so siblings stand ``fan ** level`` rows apart), masked by slot and run
length, and first children hash their parent.  All levels of a block share one
exchange and one sort; block digests are the rows of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import stored

LEVELS = 3                 # levels of a tree inside one block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the concatenated fields of one row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (stored) with ``_pos`` 0..n-1 inside each ``key`` in ascending ``order`` and ``_n``.

    Rows that agree in key and order are told apart by their place, so a value that
    holds many rows is still spread over the range partitions.
    """
    spread = rows.withColumn("_place", F.monotonically_increasing_id())
    laid = (spread.repartitionByRange(F.col(key).asc(), *[F.col(c).asc() for c in order], F.col("_place").asc())
            .sortWithinPartitions(key, *order, "_place").withColumn("_row", F.monotonically_increasing_id()))
    laid = stored(laid.withColumn("_part", F.shiftright("_row", 33)).drop("_place"), "merkle-order")
    # One row per key and range partition: a range partition holds few keys, or many short ones.
    sizes = laid.groupBy("_part", key).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    along = Window.partitionBy(key).orderBy("_part")
    starts = sizes.select("_part", key, (F.sum("_size").over(along) - F.col("_size") - F.col("_first")).alias("_shift"),
                          F.sum("_size").over(Window.partitionBy(key)).alias("_n"))
    return laid.join(starts, ["_part", key]).withColumn("_pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def _block(fan: int) -> Column:
    return F.floor(F.col("_pos") / fan ** LEVELS)


def _levels(nodes: DataFrame, fan: int) -> DataFrame:
    """``_path`` (siblings before and after, one struct a level) and the block's digest at its first row.

    ``nodes``: _key, _pos, _n, _digest and any further columns.
    """
    inside = Window.partitionBy("_key", "_block").orderBy("_pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = nodes.withColumn("_block", _block(fan)).withColumn("_d0", F.col("_digest"))
    for k in range(LEVELS):
        step, own = fan ** k, F.col(f"_d{k}")
        index = F.floor(F.col("_pos") / step)
        slot = F.pmod(index, F.lit(fan))
        run = F.least(F.lit(fan), F.ceil(F.col("_n") / step) - (index - slot))
        more = F.col("_n") > step                                  # several nodes are left at this level
        first = F.pmod(F.col("_pos"), F.lit(step)) == 0            # the row that stands for its node
        before = F.concat_ws("", *[F.when(slot >= d, F.lag(own, d * step).over(inside)) for d in range(fan - 1, 0, -1)])
        after = F.concat_ws("", *[F.when(slot + d < run, F.lead(own, d * step).over(inside)) for d in range(1, fan)])
        df = df.withColumn("_b", before).withColumn("_a", after)
        df = df.withColumn(f"_s{k}", F.when(more & first, F.struct(F.col("_b").alias("before"), F.col("_a").alias("after"))))
        df = df.withColumn(f"_d{k + 1}", F.when(first & (slot == 0), F.when(more, F.sha2(F.concat(own, "_a"), 256)).otherwise(own)))
    path = [F.col("_s0")] + [F.last(f"_s{k}", ignorenulls=True).over(so_far) for k in range(1, LEVELS)]
    df = df.withColumn("_path", F.filter(F.array(*path), lambda s: s.isNotNull()).cast(_PATH))
    return df.drop("_a", "_b", *[f"_s{k}" for k in range(LEVELS)], *[f"_d{k}" for k in range(LEVELS)]).withColumnRenamed(f"_d{LEVELS}", "_top")


def _climb(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """The frames of all rounds: ``nodes``, the digests of their blocks and so on up to one row a key."""
    rounds = [nodes]
    left = 2                                                       # at least one round, for the join on blocks
    while left > 1:
        up = (_levels(rounds[-1], fan).where(F.pmod(F.col("_pos"), F.lit(fan ** LEVELS)) == 0)
              .select("_key", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / fan ** LEVELS).alias("_n"),
                      F.col("_top").alias("_digest")))
        rounds.append(stored(up, "merkle-round"))
        left = rounds[-1].agg(F.max("_n")).first()[0] or 0
    return rounds


def _descend(rounds: list[DataFrame], fan: int, tops: DataFrame | None = None) -> DataFrame:
    """The first frame with whole paths.  ``tops``: _key, _path and further columns that every node of a key gets."""
    above = rounds[-1].select("_key", F.col("_pos").alias("_block"), F.array().cast(_PATH).alias("_above"), F.col("_digest").alias("_root"))
    if tops is not None:
        above = above.drop("_above").join(tops.withColumnRenamed("_path", "_above"), "_key")
    for i, nodes in enumerate(reversed(rounds[:-1])):
        df = (_levels(nodes, fan).drop("_top").join(above, ["_key", "_block"])
              .withColumn("_path", F.concat("_path", "_above")).drop("_above", "_block"))
        if i < len(rounds) - 2:
            above = df.drop("_n", "_digest").withColumnsRenamed({"_pos": "_block", "_path": "_above"})
    return df


def prove(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", fan: int = 8) -> DataFrame:
    """The columns of ``rows`` with ``path``, ``subroot`` and ``root``.

    Leaves of a group ascend by ``order`` (nulls first) and then by digest; every
    ``fan`` consecutive nodes become the digest of their concatenated hex digests
    (the last run may be shorter, even one) while several are left.  What remains is
    the group's subroot; subroots in bytewise order of the group (null first) give
    the root in the same way.  ``path`` holds the concatenated siblings before and
    after the node, level by level up to the root.

    Rows that agree in order and digest are interchangeable; each keeps its own row
    and a proof of its own place.  Null groups are one group, an empty table gives
    an empty table, and columns of ``rows`` named path, subroot or root are replaced.
    """
    keep = [c for c in rows.columns if c not in ("path", "subroot", "root")]
    key = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    tied = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    base = rows.select(F.struct(*keep).alias("_given"), key.alias("_key"), *tied, F.col(leaf).alias("_digest"))
    names = [f"_o{i}" for i in range(len(order))]
    leaves = positions(stored(base, "merkle-leaves"), "_key", [*names, "_digest"]).drop(*names)
    rounds = _climb(leaves, fan)
    subroots = rounds[-1].select(F.lit("all").alias("_key"), F.col("_key").alias("_group"), "_digest")
    upper = _climb(positions(subroots, "_key", ["_group"]), fan)
    tops = _descend(upper, fan).select(F.col("_group").alias("_key"), "_path", F.col("_root").alias("root"))
    out = _descend(rounds, fan, tops)
    return out.select("_given.*", F.col("_path").alias("path"), F.col("_root").alias("subroot"), "root")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(docs: DataFrame, fan: int = 8) -> DataFrame:
    """doc_id, leaf, tampered_leaf, path, subroot and root of a documents table.

    ``tampered_leaf`` is the leaf of the same row with the text's A-Z lower-cased where
    3 divides the unsigned crc32 of the decimal doc_id, else the leaf itself.  Nulls are
    fields of their own (``-``), distinct from empty texts; other columns are not read.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lower = F.translate("text", UPPER, LOWER)
    leaves = docs.select("doc_id", "lang", leaf_digest(*head, F.col("text")).alias("leaf"),
                         F.when(hit, leaf_digest(*head, lower)).alias("_changed"))
    leaves = leaves.select("doc_id", "lang", "leaf", F.coalesce("_changed", "leaf").alias("tampered_leaf"))
    return prove(leaves, "lang", ["doc_id"], "leaf", fan).drop("lang")
