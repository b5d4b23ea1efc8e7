"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

Loggers that store a conversation after every turn leave many snapshots, each a
prefix of a longer one.  Every turn gets a hash of its position and content; a
rolling sum over the turns is the hash of the prefix that ends there.  A
conversation whose whole hash equals a proper prefix of another is dropped by an
anti-join; of equal conversations the smallest id stays.  The rest is rendered.

Positions and rolling sums are made in range partitions and shifted by the totals
of the partitions before, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import stored, widest

PART_TURNS = 1000
# The rendered form of one turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _content(seed: int) -> Column:
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.xxhash64(F.lit(seed), mark("role"), F.lit("|"), mark("text"))


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return (turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                         F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
            .withColumns({"a": _content(1), "b": _content(2)}))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, part of the order, turn, a, b, pos, n and the prefix hash (x, y) at each different turn row."""
    order = ["turn", "a", "b"]
    rows = turns.select("conv_id", *order).distinct()
    laid = stored(rows.repartitionByRange(widest(rows), "conv_id", *order)
                  .withColumn("part", F.spark_partition_id()), "chat-turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = (laid.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
             .withColumns({"skip": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(whole)}))
    same = lambda l, r: l.conv_id.eqNullSafe(r.conv_id) & (l.part == r.part)
    placed = (laid.join(sizes, same(laid, sizes)).select(
        laid.conv_id, laid.part, "turn", "a", "b", "n",
        (F.row_number().over(Window.partitionBy(laid.conv_id, laid.part).orderBy(*order)) + F.col("skip")).alias("pos")))
    wide = "decimal(20,0)"
    placed = placed.withColumns({"x": F.xxhash64("pos", "a", "b").cast(wide), "y": F.xxhash64("b", "pos", "a").cast(wide)})
    rolled = placed.withColumns({"x": F.sum("x").over(inside), "y": F.sum("y").over(inside)})
    totals = (placed.groupBy("conv_id", "part").agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
              .withColumns({"sx": F.sum("tx").over(before), "sy": F.sum("ty").over(before)}))
    return (rolled.join(totals, same(rolled, totals))
            .select(rolled.conv_id, rolled.part, "turn", "a", "b", "pos", "n", (F.col("x") + F.coalesce("sx", F.lit(0))).alias("x"),
                    (F.col("y") + F.coalesce("sy", F.lit(0))).alias("y")))


def collapse(marks: DataFrame) -> DataFrame:
    """conv_id and n of the maximal conversations of ``prefixes``, one of each group of equal ones."""
    state = ["pos", "x", "y"]
    ends = marks.where("pos = n").groupBy(*state).agg(F.min("conv_id").alias("conv_id"))
    longer = marks.where("pos < n").select(*state).distinct()
    return ends.join(longer, state, "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """One string per conversation and part, turns in order.

    ``turns`` has conv_id, part, pos, role, text and n_turns (same on each row of a conversation).
    """
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    ordered = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return (turns.groupBy("conv_id", "part").agg(ordered.alias("t"), F.max("n_turns").alias("n_turns"))
            .select("conv_id", "part", F.size("t").cast("long").alias("part_turns"), "n_turns",
                    F.array_join(F.transform("t", lambda r: r["piece"]), "").alias("rendered")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, part_turns, n_turns, rendered.

    Turns are ordered by number, then by content digest; null numbers come first.
    Repeated rows count once.  Null roles and texts render as empty but differ from
    empty ones when compared.  Rows without a conversation id form one conversation.
    A conversation of more than ``part_turns`` turns comes in parts of so many, cut by position.
    """
    named = _named(turns, conv_col, turn_col, role_col, text_col)
    marks = stored(prefixes(named), "chat-prefixes")
    kept = collapse(marks).select(F.col("conv_id").alias("c"), "n_turns")
    # The parts of the order that hold kept conversations, then their turns: no join meets on a whole conversation.
    runs = (marks.select("conv_id", "part").distinct().join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("c", F.col("part").alias("r"), "n_turns"))
    places = (marks.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("r")))
              .select("c", F.col("turn").alias("t"), F.col("a").alias("ta"), F.col("b").alias("tb"), "pos", "n_turns",
                      F.floor((F.col("pos") - 1) / part_turns).cast("long").alias("part")))
    texts = named.join(places, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
                       & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    texts = texts.select("conv_id", "part", "pos", "role", "text", "n_turns").repartition("conv_id", "part")
    return render(texts.dropDuplicates(["conv_id", "part", "pos"]))
