"""Render conversations with a chat template.

The turns of one conversation are gathered (``collect_list`` per conv_id, partial aggregation
first), ordered by turn and concatenated. A rendered conversation is one output value, so its
size is bounded by that conversation, never by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES - the two chat formats.
SIMPLE_TURN = "{Role}: {text}\n\n"           # role capitalised; generation prompt "Assistant:"
SIMPLE_GENERATION_PROMPT = "Assistant:"
CHATML_TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"
CHATML_GENERATION_PROMPT = "<|im_start|>assistant\n"


def _capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(c.substr(F.lit(1), F.lit(1))), F.lower(c.substr(F.lit(2), F.length(c))))


def render_turn(template: str) -> Column:
    # a missing role or text is an empty one: the turn stays
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    if template == "simple":
        return F.concat(_capitalize(role), F.lit(": "), text, F.lit("\n\n"))
    if template == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    raise ValueError(f"unknown chat template {template!r}; choose 'simple' or 'chatml'")


def render_chat_segments(df: DataFrame, template: str = "simple", conv: str = "conv_id", turn: str = "turn",
                         name: str = "segment") -> DataFrame:
    """The rendered text of every turn, one row each (a narrow projection, no grouping).

    Concatenating a conversation's segments in ``turn`` order gives ``render_chat``'s text; use this
    form when a single conversation may be too large to hold as one value.
    """
    return df.select(conv, turn, render_turn(template).alias(name))


def render_chat(df: DataFrame, template: str = "simple", add_generation_prompt: bool = False,
                conv: str = "conv_id", turn: str = "turn", name: str = "chat") -> DataFrame:
    """One row per conversation: its turns in ``turn`` order rendered with ``template``."""
    seg = df.select(conv, turn, render_turn(template).alias("_seg"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("_seg").alias("s")))),
                        lambda x: x["s"])
    text = F.array_join(parts, "")
    if add_generation_prompt:
        text = F.concat(text, F.lit(SIMPLE_GENERATION_PROMPT if template == "simple" else CHATML_GENERATION_PROMPT))
    return seg.groupBy(conv).agg(text.alias(name))
