"""Preference formatting of conversations: DataFrame functions only.

A pair of conversations, chosen and rejected, shares its first turns up to the
first that differs. Those are rendered once, as the prompt; what follows is
rendered for each side, with marks for the characters to train on. All steps
work on turns, never on whole conversations, so a conversation of any length is
a number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """Rendered turns of pairs, from ``turns(pair_id, side, turn, role, text)`` with side ``chosen`` or ``rejected``.

    One row a turn: ``pair_id``, ``part`` (prompt, chosen or rejected), ``position`` in
    its conversation from 1, ``role``, ``segment`` and, for turns of the assistant
    after the prompt, ``trained_from`` and ``trained_to``: the characters of the
    segment that follow its header. All others are masked (null).

    Turns are in order of their number, then role and text. Repeated rows count
    once. A null role or text counts as empty; rows without a pair, a known
    side or a turn number are left out. Of equal conversations all turns are
    prompt; if one is the other's beginning, the rest of the longer one is its
    completion, and the shorter one has none. Other columns are ignored, and an
    empty table gives no rows.
    """
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.distinct().withColumn("position", F.row_number().over(order))
    content = F.concat(F.sha2("role", 256), F.sha2("text", 256))
    places = rows.select("pair_id", "position", content.alias("content")).groupBy("pair_id", "position")
    places = places.agg(F.count("*").alias("sides"), F.min("content").alias("low"), F.max("content").alias("high"))
    differ = (F.col("sides") < 2) | (F.col("low") != F.col("high"))
    shared = places.groupBy("pair_id").agg(F.min(F.when(differ, F.col("position"))).alias("first"))
    placed = rows.join(shared, "pair_id")
    prompt = F.col("first").isNull() | (F.col("position") < F.col("first"))
    placed = placed.where(~prompt | (F.col("side") == "chosen")).withColumn("part", F.when(prompt, F.lit("prompt")).otherwise(F.col("side")))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    segment = F.concat(_header(F.col("role")), F.col("text"), F.lit(CLOSE))
    return placed.select(
        "pair_id",
        "part",
        "position",
        "role",
        segment.alias("segment"),
        F.when(trained, F.length(_header(F.col("role")))).alias("trained_from"),
        F.when(trained, F.length(segment)).alias("trained_to"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen as they are, rejected with another's last reply.

    The last turn of the assistant is exchanged for that of the conversation whose
    id differs in the lowest bit, or for an empty one where there is none. A
    conversation without a reply is its own rejected side. Input columns are
    ``conv_id, turn, role, text``.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).where("pair_id is not null and turn is not null")
    last = turns.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id")
    last = last.agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("reply"))
    own = last.select("pair_id", F.col("last.turn").alias("last_turn")).join(other, "pair_id", "left")
    rejected = turns.join(own, "pair_id", "left")
    swap = (F.col("turn") == F.col("last_turn")) & (F.col("role") == TRAINED_ROLE)
    rejected = rejected.withColumn("text", F.when(swap, F.coalesce("reply", F.lit(""))).otherwise(F.col("text"))).drop("last_turn", "reply")
    return turns.withColumn("side", F.lit("chosen")).unionByName(rejected.withColumn("side", F.lit("rejected")))
