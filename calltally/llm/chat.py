"""Conversations as text of one template, verified by parsing it back.

A turn is rendered as `<s>[ROLE]role[/ROLE]text</s>`. The grammar has one reading: `</s>` ends a turn,
the first `[/ROLE]` ends the role. A text that holds one of the control strings would be read
differently, so every rendered turn is parsed and compared with its source, and what does not come
back identical is escaped: a control string, or one escaped before, gets one more backslash after its
first character. Parsing takes one backslash from each such place, so any text comes back. All of it is
DataFrame expressions; turns are moved once, by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, ROLE, ROLE_END = "<s>", "</s>", "[ROLE]", "[/ROLE]"
# The template's own strings, and others that tokenizers and trainers often read as control strings.
_CONTROL = r"(/?s>|/?ROLE\]|/?INST\]|</?SYS>>|\|[a-z_]{1,30}\|>)"
ESCAPE = r"([<\[])(\\*)" + _CONTROL
UNESCAPE = r"([<\[])\\(\\*)" + _CONTROL


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN + ROLE), role, F.lit(ROLE_END), text, F.lit(END))


def parse(turn: Column) -> Column:
    """(role, text) of one rendered turn without its end mark."""
    at = F.locate(ROLE_END, turn)
    start = len(BEGIN + ROLE)
    role = F.substr(turn, F.lit(start + 1), at - (start + 1))
    text = F.substr(turn, at + len(ROLE_END), F.length(turn))
    return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))


def parse_all(formatted: Column) -> Column:
    """Array of (role, text) of a whole rendered conversation."""
    turns = F.split(formatted, END, -1)
    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), parse)


def _returns(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is one turn and parses to its source."""
    back = parse_all(rendered)
    return (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """(conv, formatted, mask): each conversation's text, and where its loss applies.

    `mask` has (from, to) in code points of `formatted`, end excluded, one for each text of the role
    `learn`. Turns are ordered by `turn`, then role and text, nulls first; null roles and texts are
    empty; repeated rows are repeated turns; rows with a null conversation form one. An empty table
    gives no rows.
    """
    turns = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    plain = render(F.col("role"), F.col("text"))
    safe = render(escaped(F.col("role")), escaped(F.col("text")))
    shown = turns.withColumn("piece", F.when(_returns(plain, F.col("role"), F.col("text")), plain).otherwise(safe))
    in_order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long"))
    placed = shown.withColumn("start", start).withColumn("n", F.row_number().over(in_order))
    body = F.locate(ROLE_END, F.col("piece")).cast("long") + (len(ROLE_END) - 1)
    placed = placed.withColumn(
        "mask", F.when(F.col("role") == learn, F.struct(
            (F.col("start") + body).alias("from"), (F.col("start") + F.length("piece") - len(END)).alias("to")
        ))
    )
    folded = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "mask"))).alias("turns"))
    return folded.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("mask"),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(mask, lambda m: unescaped(F.substr(
            formatted, (m["from"] + 1).cast("int"), (m["to"] - m["from"]).cast("int")
        ))), ""
    )
