"""Preference pairs: shared turns rendered once as prompt, completions with loss masks.

For each pair the turns of the chosen and of the rejected conversation are compared in
order; the longest common prefix of (role, text) is the prompt. What follows on each side is
its completion, as text and as spans with a mask: spans of the ``trained`` roles count for
the loss, headers of turns and other roles do not.

Only DataFrame functions are used. A conversation is gathered by its key, which its rendered
row needs anyway; turns are put in order inside that row.

Defined results: a null role counts as the role "", a null text as empty; turns that repeat a
number are ordered by role and text; rows with a null conversation key belong to no
conversation. A side without turns renders as empty, so its completion is empty. Equal
conversations have the whole conversation as prompt and two empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

SPAN = "array<struct<start:int,stop:int,trained:boolean>>"


def gathered(turns: DataFrame, key: str, name: str, turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(key, name): the turns of each conversation in order, as an array of (role, text)."""
    one = F.struct(
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(key).alias("key"), one.alias("one")).filter("key is not null")
    ordered = F.transform(F.array_sort(F.collect_list("one")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("key").agg(ordered.alias(name))


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both arrays share from the start on."""
    least = F.least(F.size(a), F.size(b))
    unequal = F.filter(F.sequence(F.lit(0), least), lambda i: (i < least) & (F.get(a, i) != F.get(b, i)))
    return F.coalesce(F.array_min(unequal), least)


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")


def spans(turns: Column, trained: Column) -> Column:
    """Character spans of the rendered turns: head not trained, body and end mark as the role says."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        body = (state["at"] + F.char_length(head(turn))).cast("int")
        stop = (body + F.char_length(turn["text"]) + len(CLOSE)).cast("int")
        two = F.array(
            F.struct(state["at"].alias("start"), body.alias("stop"), F.lit(False).alias("trained")),
            F.struct(body.alias("start"), stop.alias("stop"), F.array_contains(trained, turn["role"]).alias("trained")),
        ).cast(SPAN)
        return F.struct(stop.alias("at"), F.concat(state["spans"], two).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", trained: tuple[str, ...] = ("assistant",), **columns: str) -> DataFrame:
    """One row per key of either side.

    Both inputs hold one row per turn: key, turn, role, text. Returns key, shared_turns,
    prompt, chosen, rejected, chosen_spans, rejected_spans (start, stop, trained; in
    characters of the completion).
    """
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    both = gathered(chosen, key, "c", **columns).join(gathered(rejected, key, "r", **columns), "key", "full")
    both = both.select("key", F.coalesce("c", nothing).alias("c"), F.coalesce("r", nothing).alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    roles = F.array(*[F.lit(r) for r in trained])
    cut = both.select("key", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        F.col("key").alias(key),
        F.col("n").cast("int").alias("shared_turns"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        spans(F.col("c"), roles).alias("chosen_spans"),
        spans(F.col("r"), roles).alias("rejected_spans"),
    )


def borrowed_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns, by conv_id, out of a table of single conversations.

    The chosen side of a pair is the conversation itself. The rejected side ends in another
    reply: its last assistant turn has the text of the last assistant turn of the partner,
    the conversation whose id differs in the lowest bit, and nothing follows it. Without
    such a turn in the partner the reply is empty; a conversation without assistant turns
    has itself as rejected side. Of turns with the same number all those of the assistant
    at the last number are replaced by one.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    replies = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    replies = replies.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("reply"))
    partner = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("borrowed"))
    ends = replies.select("conv_id", "last_turn").join(partner, "conv_id", "left")
    marked = turns.join(ends.select("conv_id", "last_turn"), "conv_id", "left")
    shown = marked.filter("last_turn is null or turn < last_turn").select("conv_id", "turn", "role", "text")
    new = ends.select("conv_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("borrowed", F.lit("")).alias("text"))
    return turns, shown.union(new)
