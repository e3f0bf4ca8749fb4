"""Preference pairs: the longest common turn prefix once as prompt, then both completions with the spans that carry loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _safe(c) -> F.Column:
    """Markers inside a text get a backslash more between < and |, so that no text can open or close a turn and different texts stay
    different; plain_text takes it out again."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def plain_text(c) -> F.Column:
    """A text as it was before it was rendered."""
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _head(turn) -> F.Column:
    return F.concat(F.lit("<|"), _safe(turn["role"]), F.lit("|>\n"))


def _rendered(turn) -> F.Column:
    return F.concat(_head(turn), _safe(turn["text"]), F.lit("<|end|>\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order as one array of role and text. An array must fit into a row, so a conversation
    may hold up to 2 GB.

    Turns sort by number, then role, then text; a null number comes first. Exactly repeated rows count once. Null roles and texts are
    empty. Rows without a conv_id take no part."""
    one = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    packed = one.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("t"))
    return packed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(turns: DataFrame, pairs: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected (rendered completions), chosen_spans and
    rejected_spans (arrays of start and end in code points of the completion: what carries loss), identical.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id; other columns of either are ignored. A common prefix holds
    turns of equal role and text, compared as they are; markers inside them are escaped only where they are rendered. Loss lies on the trained role's texts with their end markers; all else is masked. A conversation that
    is missing or null has no turns, so its completion is empty and nothing is common. Identical conversations are all prompt, with
    empty completions, and are marked. Everything is DataFrame functions; the only shuffles are one grouping of turns and two joins.
    packed: conversations(turns), where it is at hand."""
    packed = conversations(turns) if packed is None else packed
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    sides = pairs.select("pair_id", "chosen_id", "rejected_id")
    for side in ("chosen", "rejected"):
        sides = sides.join(packed.select(F.col("conv_id").alias(f"{side}_id"), F.col("turns").alias(f"_{side}")), f"{side}_id", "left")
        sides = sides.withColumn(f"_{side}", F.coalesce(f"_{side}", none))
    return _formatted(sides)


def _formatted(sides: DataFrame) -> DataFrame:
    """Pairs with the turns of both sides (_chosen, _rejected) as prompt and completions."""
    shorter = F.least(F.size("_chosen"), F.size("_rejected"))
    steps = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    same = lambda i: F.col("_chosen")[i] == F.col("_rejected")[i]
    sides = sides.withColumn("prompt_turns", F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & same(i), n + 1).otherwise(n)))
    joined = lambda a: F.array_join(F.transform(a, _rendered), "")
    out = sides.withColumn("prompt", joined(F.slice("_chosen", F.lit(1), F.col("prompt_turns"))))
    for side in ("chosen", "rejected"):
        rest = F.slice(f"_{side}", F.col("prompt_turns") + 1, F.size(f"_{side}"))
        out = out.withColumn(f"_{side}", rest).withColumn(side, joined(F.col(f"_{side}")))
        # Walk the turns with the running length; a trained turn adds the span of its text and end marker.
        start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))")

        def walk(state, turn):
            begin, end = state["at"] + F.length(_head(turn)), state["at"] + F.length(_rendered(turn))
            span = F.array(F.struct(begin.cast("long").alias("start"), (end - 1).cast("long").alias("end")))
            spans = F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

        out = out.withColumn(f"{side}_spans", F.aggregate(f"_{side}", start, walk)["spans"])
    identical = (F.size("_chosen") == 0) & (F.size("_rejected") == 0) & (F.col("prompt_turns") > 0)
    return out.withColumn("identical", identical).select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "identical")


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table that names none: conversations 2k (chosen) and 2k + 1 (rejected), if at least one is there."""
    ids = turns.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


def format_branches(turns: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """As format_preferences, for pairs that branch, in a table that names none: a conversation is the chosen side; the rejected one has
    the same turns up to its last answer and there the last answer of the conversation whose id differs in the lowest bit.

    pair_id and rejected_id are -1 - conv_id. Conversations without an answer give no pair; without a neighbour's answer the rejected
    side ends with the common turns. Negative and null ids take no part. One grouping of turns; only last answers are joined to it."""
    packed = (conversations(turns) if packed is None else packed).where("conv_id >= 0")
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)), lambda i: i.isNotNull())
    packed = packed.withColumn("at", F.array_max(places)).where("at is not null")
    answers = packed.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("turns", F.col("at"))["text"].alias("other"))
    both = packed.join(answers, "conv_id", "left")
    other = F.struct(F.lit(TRAINED_ROLE).alias("role"), F.col("other").alias("text"))
    stem = F.slice("turns", F.lit(1), F.col("at"))
    new = F.lit(-1) - F.col("conv_id")
    return _formatted(both.select(new.alias("pair_id"), F.col("conv_id").alias("chosen_id"), new.alias("rejected_id"), F.col("turns").alias("_chosen"),
                                  F.when(F.col("other").isNull(), stem).otherwise(F.concat(stem, F.array(other))).alias("_rejected")))
