"""Packing by optimal length buckets.

The histogram of token counts over all documents is one small aggregate; dynamic
programming on it chooses the bucket boundaries with the least padding.  Inside a
bucket every sequence is padded to the boundary and a batch takes as many as the
token budget holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import stored
from airgrid.llm.tokens import VOCABULARY, count_tokens, share_vocabulary

BUCKETS, BUDGET, EXACT = 16, 65536, 4096
_BLOCK_ROWS = 50_000


def length_class(n: Column, exact: int = EXACT) -> Column:
    """Lengths up to ``exact`` as they are, longer ones rounded up to one part in ``exact / 2``.

    That bounds the histogram: ``exact`` classes and half as many per doubling.
    """
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")))
                                         - int(np.log2(exact)) + 1)).cast("long")
    return F.when(n <= exact, n).otherwise(F.ceil(n / width).cast("long") * width).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascending and different.  cost(i, j) pads lengths i+1..j to the j-th;
    the best previous cut is a lower envelope of lines, so a layer takes linear time.
    """
    n = len(lengths)
    if n == 0:
        return []
    c = [0, *np.cumsum(counts).tolist()]
    b = [0, *lengths.tolist()]
    # padded tokens up to class j when the last bucket ends there
    best = [0] + [b[j] * c[j] for j in range(1, n + 1)]
    cuts: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        new, cut = [0] * (n + 1), [0] * (n + 1)
        hull: list[int] = []                                    # line i: best[i] - c[i] * x

        def worse(i: int, j: int, k: int) -> bool:
            """Line j is nowhere lowest between i and k (slopes fall)."""
            return (best[k] - best[i]) * (c[j] - c[i]) <= (best[j] - best[i]) * (c[k] - c[i])  # noqa: B023
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) - head >= 2 and worse(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            x = b[j]
            while len(hull) - head >= 2 and best[hull[head + 1]] - c[hull[head + 1]] * x <= best[hull[head]] - c[hull[head]] * x:
                head += 1
            i = hull[head]
            new[j], cut[j] = best[i] - c[i] * x + x * c[j], i
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(b[j])
        j = cut[j]
        if j == 0:
            break
    if j:
        out.append(b[j])
    return sorted(set(out))


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch and slot of every row of ``docs``.

    ``batch`` counts from 0 in its bucket; ``slot`` is the place in the batch.  A
    sequence longer than the budget is a batch of its own, whole.  A null length is
    0; empty sequences are padded like others.  Rows without an id and repeated rows
    are packed each on its own; an empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
                  .withColumn("row", F.monotonically_increasing_id()), "lengths")
    rows = rows.withColumn("class", length_class(F.col("n_tokens")))
    # A class stands for its longest real length, so every boundary is one.
    hist = sorted((r["top"], r["n"]) for r in rows.groupBy("class").agg(
        F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in hist)
    ends = optimal_boundaries(np.array([x for x, _ in hist]), np.array([n for _, n in hist]), buckets) or [0]
    plan = F.array(*[F.struct(F.lit(k).cast("int").alias("bucket"), F.lit(int(e)).cast("long").alias("padded_length"),
                              F.lit(max(1, budget // max(1, int(e)))).cast("long").alias("fit")) for k, e in enumerate(ends)])
    blocks = max(1, -(-total // _BLOCK_ROWS))
    dealt = (rows.withColumn("p", F.element_at(F.filter(plan, lambda p: p["padded_length"] >= F.col("n_tokens")), 1))
             .select("doc_id", "n_tokens", "row", "p.*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")))
    sizes = (dealt.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("size"))
             .withColumn("skip", F.coalesce(F.sum("size").over(
                 Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .select("bucket", "block", "skip"))
    place = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("row")) - 1
    placed = dealt.withColumn("at", place).join(sizes, ["bucket", "block"]).withColumn("at", F.col("at") + F.col("skip"))
    return placed.select("doc_id", "n_tokens", "bucket", "padded_length", F.floor(F.col("at") / F.col("fit")).cast("long").alias("batch"),
                         F.pmod(F.col("at"), F.col("fit")).cast("long").alias("slot"))


def pack_texts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text",
               buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pack`` by the token counts of whole texts."""
    counts = count_tokens(share_vocabulary(docs.sparkSession, vocabulary))
    return pack(docs, counts(F.col(text_col)), id_col, buckets, budget)
