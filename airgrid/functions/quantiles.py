"""Exact quantiles without collecting a column into one task.

``percentile`` buffers every distinct value of a group in one task.  Here all
columns go through one pass: equal values are counted (with map-side
pre-aggregation), the counts are range-partitioned and sorted by (column, value),
and global ranks are the totals of the partitions before plus a running sum inside
the partition.  Only the rows at the requested ranks reach the driver.  Linear
interpolation between neighbouring ranks, as pandas / ``quantile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import cut_lineage


def exact_quantiles_many(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles ``qs`` of every column; NULL and NaN are left out, a column without values gives None."""
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
    counts = (df.select(F.explode(entries).alias("e")).select("e.c", "e.v")
              .where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    laid = cut_lineage(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (laid.groupBy("c", "part").agg(F.sum("n").alias("size"))
             .withColumns({"skip": F.coalesce(F.sum("size").over(before), F.lit(0)),
                           "total": F.sum("size").over(Window.partitionBy("c"))}))
    upto = F.col("skip") + F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))
    ranked = laid.join(sizes, ["c", "part"]).withColumn("upto", upto)
    wanted = F.array(*[f(F.lit(q) * (F.col("total") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)])
    hit = F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    rows = ranked.select("c", "v", "total", F.explode(F.array_distinct(hit)).alias("rank")).collect()
    at = {(r["c"], r["rank"]): r["v"] for r in rows}
    totals = {r["c"]: r["total"] for r in rows}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = []
        for q in qs:
            if c not in totals:
                out[c].append(None)
                continue
            pos = q * (totals[c] - 1)
            lo, hi = at[c, math.floor(pos)], at[c, math.ceil(pos)]
            out[c].append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    return exact_quantiles_many(df, [col], qs)[col]
