"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as assistant and
the others as named users; only the assistant's words and closing mark are
learned from. A rendering is a run of segments, one a turn, with its place in the
whole: a dialogue is never gathered in one row, and the running places are summed
over blocks of turns first, so one long dialogue spreads over many tasks.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns (by their number) whose places are summed in one task.
BLOCK_TURNS = 512
#: A turn without role is this speaker's; these speakers take no part and keep their role.
NOBODY = "unknown"
SYSTEM = "system"


def _plain(column: Column) -> Column:
    """Text that can't be taken for a mark."""
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def perspectives(conversations: DataFrame, *, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Segments of each dialogue (conv_id, turn, role, text) in each participant's perspective.

    Returns conv_id, perspective, seq (from 1), turn, speaker, chat_role, segment,
    char_start and char_end (where the segment lies in the rendering), mask_start
    and mask_end (what is learned from, equal where nothing is).

    Turns are ordered by turn (null first), then role, then text; repeated rows
    are turns of their own. A null text is empty, a null role the speaker
    ``unknown``, a null conv_id a dialogue like any other; ``system`` keeps its role
    in all perspectives, and a dialogue of system turns alone has none. Other
    columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _plain(F.coalesce(F.col("role").cast("string"), F.lit(NOBODY))).alias("speaker"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    takes = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    views = turns.join(takes, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    views = views.withColumn("chat_role", F.when(F.col("speaker") == SYSTEM, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user"))
    head = F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "chat_role", F.lit("|>\n")))
    views = views.withColumn("head", head).withColumn("size", F.length("head") + F.length("body") + F.lit(len("<|end|>\n")))
    key = ["conv_id", "perspective"]
    blocks = views.groupBy(*key, "block").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    ahead = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}_before") for x in ("chars", "turns")])
    inside = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "body")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = views.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    placed = placed.withColumn("seq", F.row_number().over(inside) + F.col("turns_before")).withColumn("char_end", F.sum("size").over(so_far) + F.col("chars_before"))
    start = F.col("char_end") - F.col("size")
    learned = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "speaker", "chat_role", F.concat("head", "body", F.lit("<|end|>\n")).alias("segment"),
        start.alias("char_start"), "char_end",
        F.when(learned, start + F.length("head")).otherwise(F.lit(0)).alias("mask_start"), F.when(learned, F.col("char_end") - 1).otherwise(F.lit(0)).alias("mask_end"),
    )
