"""Preference formatting of conversations.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt;
what follows becomes the pair of completions, in which only assistant turns are trained on (mask 1).
The result has a row per rendered turn, not a string per conversation, so a conversation of any length
is spread over the cluster: turns are compared by one aggregation on (pair, turn, role, text), the first
difference of a pair is a minimum, and the join that brings it back to the turns is split by AQE where
a pair is hot.

DataFrame functions only.

Defined cases: a turn number may occur several times (its turns are then compared as a set with
counts, rendered in the order of role and text); null turn numbers come last; null roles and texts are
equal to each other, and rendered as empty; a side without turns leaves an empty prompt; equal conversations are all
prompt; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers around a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_LAST = (1 << 63) - 1


def render(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit(START), F.coalesce(role, empty), F.lit("\n"), F.coalesce(text, empty), F.lit(f"{END}\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, part, turn, role, text, rendered, mask, copies)`` from ``(pair_id, turn, role, text)`` of both sides;
    part is prompt, chosen or rejected, and copies the number of equal turns with that number."""
    names = ["pair_id", "turn", "role", "text"]
    sides = chosen.select(*names, F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(rejected.select(*names, F.lit(0).alias("c"), F.lit(1).alias("r")))
    sides = sides.withColumn("turn", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)))
    turns = sides.groupBy(*names).agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    differ = turns.where("c <> r").groupBy("pair_id").agg(F.min("turn").alias("_from")).withColumnRenamed("pair_id", "_pair")
    joined = turns.join(differ, F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
    shared = F.col("_from").isNull() | (F.col("turn") < F.col("_from"))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("copies"))
    parts = F.when(shared, F.array(part("prompt", F.col("c")))).otherwise(F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))))
    rows = joined.select("pair_id", "turn", "role", "text", F.explode(parts).alias("p")).where("p.copies > 0")
    mask = F.when((F.col("p.part") != "prompt") & F.col("role").eqNullSafe(F.lit(TRAINED)), 1).otherwise(0)
    return rows.select(
        "pair_id", "p.part", F.when(F.col("turn") < _LAST, F.col("turn")).alias("turn"), "role", "text",
        render(F.col("role"), F.col("text")).alias("rendered"), mask.alias("mask"), F.col("p.copies").cast("long").alias("copies"),
    )


def with_negatives(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations ``(conv_id, turn, role, text)``: chosen is the conversation, rejected the
    same with the closing assistant turns of its neighbour (conv_id with the last bit flipped) in the
    place of its own; without a neighbour, or without an assistant turn there, it has none."""
    key = ["conv_id", "turn"]
    turns = turns.select(*key, "role", "text")
    last = turns.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max("turn").alias("last"))
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    closing = turns.join(last, "conv_id").where((F.col("turn") == F.col("last")) & (F.col("role") == TRAINED)).select(*key, "role", "text")
    own = last.select(F.col("conv_id").alias("pair_id"), "last")
    context = chosen.join(own, "pair_id", "left").where("last IS NULL OR turn IS NULL OR turn < last").select("pair_id", "turn", "role", "text")
    other = closing.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "role", "text").join(own, "pair_id")
    return chosen, context.unionByName(other.select("pair_id", F.col("last").alias("turn"), "role", "text"))
