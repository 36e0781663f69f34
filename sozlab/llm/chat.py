"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Loggers often store a conversation again after each turn.  Every stored conversation gets rolling hashes of its
turn prefixes; a conversation whose whole-length hash is a proper prefix hash of another one is a snapshot and an
anti-join removes it.  What is left - the maximal conversations - is rendered as one training text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """One row per stored turn with its place and two 64-bit rolling hashes of the prefix ending there.

    Each turn's hash is salted by its place, so xor over the ordered prefix identifies the sequence.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("place", F.row_number().over(in_order))
    first = F.xxhash64(F.lit(11), "place", "role", F.lit("\x1f"), "text")
    second = F.xxhash64(F.lit(29), "text", F.lit("\x1e"), "role", "place")
    return placed.withColumn("h1", F.bit_xor(first).over(so_far)).withColumn("h2", F.bit_xor(second).over(so_far))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(f"{CLOSE}\n"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: conv_id, n_turns, n_copies, n_chars, n_user, n_assistant, chat.

    A conversation is the distinct (turn, role, text) rows of a conv_id in that order (nulls first; null role or text
    reads as empty).  Removed are conversations whose whole sequence of (role, text) begins a longer one; of equal
    ones the smallest conv_id stays and n_copies counts them.  A null conv_id is a conversation of its own (and the
    smallest); exactly repeated rows count once; an empty table gives an empty result; other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    whole = Window.partitionBy("conv_id")
    prefixes = rolling_prefixes(turns).withColumn("n_turns", F.max("place").over(whole))
    ends = prefixes.where(F.col("place") == F.col("n_turns"))
    # equal conversations meet here, summed map-side, so a hot conversation is one row per task
    distinct = ends.groupBy("h1", "h2", "n_turns").agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("keep"),
        F.count("*").alias("n_copies"),
    )
    inner = prefixes.where(F.col("place") < F.col("n_turns")).select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    maximal = distinct.join(inner, ["h1", "h2", "n_turns"], "left_anti").select(
        F.col("keep.conv_id").alias("conv_id"), "n_turns", "n_copies"
    )
    chosen = turns.alias("t").join(maximal.alias("m"), F.expr("t.conv_id <=> m.conv_id"))
    return (
        chosen.groupBy(F.col("m.conv_id").alias("conv_id"), "n_turns", "n_copies")
        .agg(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"),
            F.count(F.when(F.col("role") == "user", 1)).alias("n_user"),
            F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"),
        )
        .select(
            "conv_id",
            F.col("n_turns").cast("long").alias("n_turns"),
            "n_copies",
            "n_user",
            "n_assistant",
            F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["text"])), "").alias("chat"),
        )
        .withColumn("n_chars", F.length("chat").cast("long"))
        .select("conv_id", "n_turns", "n_copies", "n_chars", "n_user", "n_assistant", "chat")
    )
