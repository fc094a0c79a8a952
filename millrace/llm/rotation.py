"""Chat formatting by perspective rotation, in DataFrame operations only.

Each participant of a conversation gets its own rendering: that speaker's turns
are the assistant's and are to be learned; all other participants are named
users; system turns stay what they are.  A long conversation is rendered in
blocks of ``BLOCK_TURNS`` turn numbers, so no row holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 256
SYSTEM = "system"


def _segments(me: str, turns: str) -> Column:
    """Head, body and whether to learn, of each turn, as seen by the participant in column ``me``."""

    def one(t: Column) -> Column:
        mine = t["role"].eqNullSafe(F.col(me))
        name = F.coalesce(t["role"], F.lit("unknown"))
        head = F.when(mine, F.lit("<|assistant|>\n")).when(t["role"].eqNullSafe(F.lit(SYSTEM)), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")).alias("body"), mine.alias("learn"))

    return F.transform(turns, one)


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each conversation, block and participant.

    Columns: conv_id, block, perspective, n_turns, n_learned, rendered, mask
    (array of start and end, in characters of ``rendered``, of what the
    participant says: the text and the end mark of its turns).  A participant
    of any block sees all blocks.  Participants are the distinct non-null roles
    besides system; a conversation without any gives no row.  A null text
    renders as empty, a null role as a user named unknown, who is no
    participant.  Turns are ordered by number, then role, then text, nulls
    first; repeated rows are rendered each.  Null turn numbers form a block of
    their own (null), rows with a null conversation id a conversation of their
    own.  Other columns are never read.  An empty table gives an empty table.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.floor(F.col(turn) / block_turns).cast("bigint").alias("block"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parts = rows.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = blocks.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("segments", _segments("perspective", "turns"))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"]) - 1  # without the line feed after the end mark
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + 1).cast("int").alias("at"), F.when(s["learn"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return seen.select(
        "conv_id",
        "block",
        "perspective",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["learn"])).cast("bigint").alias("n_learned"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.aggregate("segments", start, step, lambda acc: acc["mask"]).alias("mask"),
    )
