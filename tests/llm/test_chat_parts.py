"""Chats: parts hold a bounded number of turns, whatever the turn numbers."""

from pyspark.sql import functions as F

from airgrid.llm import chat


def test_parts_are_cut_by_position(spark):
    text = F.concat(F.lit("m"), F.col("id"))
    rows = spark.range(900).select(F.lit(None).cast("long").alias("conv_id"), (F.col("id") % 30).alias("turn"), F.lit("user").alias("role"), text.alias("text"))
    nulls = spark.range(250).select(F.lit(7).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), text.alias("text"))
    far = spark.range(5).select(F.lit(8).cast("long").alias("conv_id"), (F.col("id") * 100000).alias("turn"), F.lit("user").alias("role"), text.alias("text"))
    df = rows.unionByName(nulls).unionByName(far).unionByName(rows.limit(10))
    got = chat.format_chats(df.repartition(6), part_turns=100).collect()
    want = [(None, p, 100, 900) for p in range(9)] + [(7, 0, 100, 250), (7, 1, 100, 250), (7, 2, 50, 250), (8, 0, 5, 5)]
    assert sorted(map(str, ((r.conv_id, r.part, r.part_turns, r.n_turns) for r in got))) == sorted(map(str, want))
    shown = "".join(r.rendered for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.part))
    turns = [int(m[1:]) % 30 for m in shown.replace("<|im_start|>user\n", "").split("<|im_end|>\n")[:-1]]
    assert len(turns) == 900 and turns == sorted(turns)
