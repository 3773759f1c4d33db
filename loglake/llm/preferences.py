"""Preference examples from pairs of conversations.

The longest common prefix of turns (same role and text) of the chosen and the
rejected conversation is rendered once as the prompt; what follows in each is
its completion.  A completion comes with a mask: one entry per turn, `m` and
the number of characters that are not trained on (the turn's header, and the
text of turns that the assistant did not write), then for assistant turns `t`
and the number of characters that are (the text and the end mark).

All steps are row-wise array functions after one grouping of turns by
conversation; a conversation is one example and so one row by its nature.

Defined results: turns without a conversation id are left out; turns with the
same number are ordered by role and text, repeated rows are repeated turns; a
null text is empty, a null role `unknown`; equal conversations give the whole
conversation as prompt and two empty completions; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
END = "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns as an ordered array of (turn, role, text)."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    def entry(t):
        head, body = F.length(_header(t)), F.length(t["text"]) + len(END)
        return F.when(t["role"] == ASSISTANT, F.concat(F.lit("m"), head, F.lit(" t"), body)).otherwise(
            F.concat(F.lit("m"), head + body)
        )

    return F.array_join(F.transform(turns, entry), " ")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From (pair_id, chosen, rejected) arrays of turns: prompt, completions and masks."""
    def same(c, i):
        other = F.get(F.col("rejected"), i)
        return F.coalesce((c["role"] == other["role"]) & (c["text"] == other["text"]), F.lit(False))

    differs = F.array_position(F.transform("chosen", same), F.lit(False))
    cut = pairs.select(
        "pair_id", "chosen", "rejected",
        F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int").alias("n_prefix"),
    )
    rest = lambda c: F.slice(F.col(c), F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    parts = cut.select(
        "pair_id", "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("prefix"),
        rest("chosen").alias("chosen"), rest("rejected").alias("rejected"),
    )
    return parts.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), render(F.col("prefix")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"), mask(F.col("chosen")).alias("chosen_mask"),
        render(F.col("rejected")).alias("rejected"), mask(F.col("rejected")).alias("rejected_mask"),
    )


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for tables without judged ones: the conversation as it is against
    the same one with its last assistant turn taken from the neighbour, whose
    id differs in the last bit.  Without a neighbour that has an assistant
    turn the rejected conversation lacks that turn.  A conversation without an
    assistant turn has nothing to prefer and gives no pair.
    """
    def at_last(c):
        return F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == ASSISTANT, i)))

    whole = conversations(turns).withColumn("last", at_last("turns")).where("last is not null")
    reply = whole.select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.get(F.col("turns"), F.col("last"))["text"].alias("reply")
    )
    both = whole.join(reply, "conv_id", "left")
    swapped = F.transform("turns", lambda t, i: F.when(
        i == F.col("last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("reply").alias("text"))
    ).otherwise(t))
    shorter = F.filter("turns", lambda t, i: i != F.col("last"))
    return both.select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.when(F.col("reply").isNotNull(), swapped).otherwise(shorter).alias("rejected"),
    )
