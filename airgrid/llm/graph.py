"""Connected components as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import stored


def _jump(label: DataFrame) -> DataFrame:
    """Follow each label one step further: v -> label(label(v))."""
    nxt = label.select(F.col("label").alias("v"), F.col("node").alias("_n"))
    up = label.select(F.col("node").alias("v"), F.col("label").alias("further"))
    return nxt.join(up, "v", "left").select(F.col("_n").alias("node"), F.coalesce("further", "v").alias("label"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", kind: str = "long") -> DataFrame:
    """node, component (smallest node reachable) for every node that an edge touches; nodes are of type ``kind``.

    Each round lets every node point at its smallest neighbour, follows the
    pointers two steps and contracts the edges to the labels; contracted edges
    inside one label vanish.  Rounds end when no edge is left; every round's result
    is a stored table.  Nothing but edge counts reaches the driver.  Nulls are left
    out, loops only name their node, repeated edges do not matter.
    """
    e = (edges.select(F.col(src).cast(kind).alias("a"), F.col(dst).cast(kind).alias("b"))
         .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    total = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        label = stored(_jump(_jump(label)), "labels")
        if total is None:
            total = label
        else:
            step = label.select(F.col("node").alias("label"), F.col("label").alias("to"))
            total = stored(total.join(step, "label", "left")
                           .select("node", F.coalesce("to", "label").alias("label")), "labels")
        la = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        lb = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        e = stored(e.join(la, "a").join(lb, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
                   .where("a < b").distinct(), "edges")
    if total is None:
        total = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return (total.unionByName(loops).groupBy("node").agg(F.min("label").alias("component")))
