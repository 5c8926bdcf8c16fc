"""Cleansing of logged calls: clamps, fills, parsing, imputation, keyed de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers, pricing, text, times


def clamp_calls(df: DataFrame) -> DataFrame:
    """Raise tokens, latency and cost to their legal minimum."""
    return df.withColumns(
        {
            "tokens_in": F.greatest(F.lit(1), F.col("tokens_in")),
            "tokens_out": F.greatest(F.lit(1), F.col("tokens_out")),
            "latency_ms": F.greatest(F.lit(0.001), F.col("latency_ms")),
            "cost_usd": F.greatest(F.lit(0.0), F.col("cost_usd")),
        }
    )


def drop_blank_pairs(df: DataFrame) -> DataFrame:
    """Keep rows whose prompt and response both hold more than whitespace."""
    return df.where(~text.is_blank(F.col("prompt")) & ~text.is_blank(F.col("response")))


def optional(df: DataFrame, name: str) -> Column:
    """The column, or null text where the file has no such column."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def fill_upload_columns(df: DataFrame) -> DataFrame:
    """Typed upload columns with defaults for missing, blank or unreadable cells."""
    prompt, response = text.strip(F.col("prompt")), text.strip(F.col("response"))
    return df.select(
        *[c for c in df.columns if c.startswith("_")],
        prompt.alias("prompt"),
        response.alias("response"),
        text.filled(optional(df, "model"), values.UPLOAD_MODEL).alias("model"),
        numbers.parse_int(optional(df, "tokens_in"), text.tokens_by_words(prompt)).alias("tokens_in"),
        numbers.parse_int(optional(df, "tokens_out"), text.tokens_by_words(response)).alias("tokens_out"),
        numbers.parse_float(optional(df, "latency_ms"), F.lit(0.0)).alias("latency_ms"),
        numbers.parse_float(optional(df, "cost_usd"), F.lit(0.0)).alias("cost_usd"),
        numbers.parse_float(optional(df, "quality_rating"), F.lit(None)).alias("quality_rating"),
        text.filled(optional(df, "criteria"), None).alias("criteria"),
    )


def upload_rating(rating: Column) -> Column:
    """Rating on a 0–10 or 0–1 scale as 0–1; a rating above 1 is taken as 0–10."""
    return numbers.clamp01(F.when(rating > 1, rating / 10).otherwise(rating))


def benchmark_rating(rating: Column) -> Column:
    """Benchmark rating, always on a 0–10 scale, 5 when missing."""
    return F.coalesce(rating, F.lit(5.0)) / 10


def backfilled_time(raw: Column, key: Column, anchor: Column) -> Column:
    """Parsed wall-clock time, or a repeatable instant within the seven days before `anchor`."""
    return F.coalesce(
        times.wall_clock(raw), times.before(anchor, numbers.draw(key, "time", 7 * 86400 + 1))
    )


def imputed_latency(model: Column, key: Column) -> Column:
    """A repeatable latency within the range of the model, one decimal."""
    low, high = pricing.latency_low(model), pricing.latency_high(model)
    return F.round(low + numbers.draw_unit(key, "latency") * (high - low), 1)


def imputed_tokens_in(tokens: Column, key: Column) -> Column:
    return F.coalesce(tokens, (F.lit(50) + numbers.draw(key, "tokens_in", 451)).cast("int"))


def imputed_tokens_out(tokens: Column, key: Column) -> Column:
    return F.coalesce(tokens, (F.lit(20) + numbers.draw(key, "tokens_out", 281)).cast("int"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of every key with the lowest `order`, which is distinct within a key.

    Only keys and orders are aggregated, by hash; whole rows are met once, by a semi join.
    """
    lowest = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_order"))
    return df.join(lowest, df[key].eqNullSafe(F.col("_key")) & (df[order] == F.col("_order")), "left_semi")


def content_hashes(df: DataFrame, criteria: Column) -> DataFrame:
    return df.withColumn(
        "content_key", text.content_key(F.col("prompt"), F.col("response"), criteria)
    )


def generated_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", F.col("tokens_in") + F.col("tokens_out"))


def flatten_messages(df: DataFrame, messages: str, blocks: str) -> DataFrame:
    """Prompt from the contents of a message list, response from the text of its blocks."""
    return df.withColumns(
        {
            "prompt": F.array_join(
                F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " "
            ),
            "response": F.array_join(
                F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]),
                " ",
            ),
        }
    )


def with_neighbours(
    df: DataFrame, group: str, order: str, columns: Sequence[str], stretch: int = 256
) -> DataFrame:
    """Previous and next value of `columns` within a group, in `order` (a whole number).

    A window over the group would put a huge group into one task. The window runs over stretches
    of the order instead, and only the two edge rows of every stretch look across: their
    neighbours come from a window over edges, which is `stretch` times smaller.
    """
    kept = F.struct(*columns)
    # As a struct the group joins by plain equality even where it is null.
    marked = df.withColumns(
        {"_group": F.struct(group), "_part": F.floor(F.col(order) / stretch)}
    )
    inside = Window.partitionBy("_group", "_part").orderBy(order)
    near = marked.withColumns(
        {"_prev": F.lag(kept).over(inside), "_next": F.lead(kept).over(inside)}
    )
    along = Window.partitionBy("_group").orderBy("_part")
    edges = (
        marked.groupBy("_group", "_part")
        .agg(
            F.min_by(kept, F.col(order)).alias("_head"), F.max_by(kept, F.col(order)).alias("_tail")
        )
        .select(
            "_group",
            "_part",
            F.lag("_tail").over(along).alias("_before"),
            F.lead("_head").over(along).alias("_after"),
        )
    )
    joined = near.join(edges, ["_group", "_part"], "left")
    previous, following = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    return joined.select(
        *df.columns,
        *[previous[c].alias(f"prev_{c}") for c in columns],
        *[following[c].alias(f"next_{c}") for c in columns],
    )


def prompt_response_pairs(turns: DataFrame) -> DataFrame:
    """User turns directly followed by an assistant turn of the same conversation."""
    linked = with_neighbours(turns, "conv_id", "turn", ["role", "text"])
    return linked.where(
        (F.col("role") == "user") & (F.col("next_role") == "assistant")
    ).select(
        "conv_id",
        "turn",
        F.col("prev_role"),
        F.col("prev_text"),
        F.col("text").alias("prompt"),
        F.col("next_text").alias("response"),
    )
