"""Preference formatting: one prompt for a chosen and a rejected conversation, and their masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chat template: a header with the role, the text, and an end mark.
HEADER, AFTER_ROLE, END = "<|start|>", "\n", "<|end|>\n"
TRAINED_ROLES = ("assistant",)


def turns_of(conversations: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair with the sorted turns of its chosen and its rejected conversation.

    Turns are ordered by number, then role and text, null first; repeated rows stay. Nulls in role or text are
    empty strings. Conversations without a pair or a side are left out.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    side = lambda flag: F.array_sort(F.collect_list(F.when(F.col("is_chosen") == flag, F.col("one_turn"))))
    rows = conversations.select(pair.alias("pair_id"), chosen.alias("is_chosen"), turn.alias("one_turn"))
    rows = rows.filter(F.col("pair_id").isNotNull() & F.col("is_chosen").isNotNull())
    return rows.groupBy("pair_id").agg(side(True).alias("chosen_turns"), side(False).alias("rejected_turns"))


def said(turn: Column) -> Column:
    return F.concat(F.lit(HEADER), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, said), "")


def masked(turns: Column) -> Column:
    """Spans (start, end) in code points of what is trained on: text and end mark of the trained roles."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        end = acc["at"] + F.length(said(turn))
        text_at = end - F.length(turn["text"]) - len(END)
        span = F.array(F.struct(text_at.alias("start"), end.alias("end")))
        kept = F.when(turn["role"].isin(*TRAINED_ROLES), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_pairs(conversations: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The longest common prefix of turns (same role and text) is rendered once as the prompt. What follows is the
    completion of either side; its mask lists the spans to train on. Equal conversations have empty completions;
    a pair with one side only has an empty prompt and an empty other completion.
    """
    pairs = turns_of(conversations, pair, chosen)
    shorter = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    same = F.zip_with(
        F.slice("chosen_turns", F.lit(1), shorter), F.slice("rejected_turns", F.lit(1), shorter),
        lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]),
    )
    pairs = pairs.withColumn("same", same)
    stop = F.array_position("same", False)
    pairs = pairs.withColumn("n_common", F.when(stop > 0, stop - 1).otherwise(F.size("same")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    pairs = pairs.select(
        "pair_id", "n_common", F.slice("chosen_turns", F.lit(1), F.col("n_common")).alias("common_turns"),
        rest("chosen_turns").alias("chosen_rest"), rest("rejected_turns").alias("rejected_rest"),
    )
    return pairs.select(
        "pair_id", "n_common", rendered(F.col("common_turns")).alias("prompt"),
        rendered(F.col("chosen_rest")).alias("chosen"), rendered(F.col("rejected_rest")).alias("rejected"),
        masked(F.col("chosen_rest")).alias("chosen_mask"), masked(F.col("rejected_rest")).alias("rejected_mask"),
    )
