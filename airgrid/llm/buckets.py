"""Hot-bucket splitting: every pair of a bucket's members meets in exactly one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, key: list[str], member: Column, block: int) -> DataFrame:
    """Deal the members of each bucket into groups (``key``, _i, _j), with each row's ``_side``.

    A bucket of more than ``block`` members is cut into blocks by a hash of the
    member and each pair of blocks i <= j is a group, so no group holds many more
    than ``2 * block`` rows; a smaller bucket is one group.  Pairs inside one block
    meet in the group (i, i), others in (i, j).  Buckets of one member are left out.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    n = F.ceil(F.col("_size") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), member), n).cast("int")
    lows = F.transform(F.sequence(F.lit(0), F.col("_own")), lambda i: F.struct(i.alias("i"), F.col("_own").alias("j")))
    highs = F.when(F.col("_own") + 1 < F.col("_n"), F.transform(
        F.sequence(F.col("_own") + 1, F.col("_n") - 1), lambda j: F.struct(F.col("_own").alias("i"), j.alias("j"))))
    pairs = F.concat(lows, F.coalesce(highs, F.array().cast("array<struct<i:int,j:int>>")))
    return (rows.join(sizes, key).withColumns({"_n": n}).withColumn("_own", own)
            .withColumn("_g", F.explode(pairs))
            .withColumns({"_i": F.col("_g.i"), "_j": F.col("_g.j"), "_side": (F.col("_own") == F.col("_g.j")).cast("int")})
            .drop("_size", "_n", "_own", "_g"))
