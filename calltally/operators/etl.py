"""Loads: arena battles, benchmark rows and uploaded datasets into completions and scores.

Every load assigns ids once, from the row order of its input, and both tables of a load come from
the same ids. Nothing random is used: imputed values are repeatable draws on a key of the row, so
a task that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers, pricing, text, times
from calltally.operators import cleaning
from calltally.operators.text_scores import combined_rouge, text_scores

COMPLETION_COLUMNS = (
    "id", "timestamp", "prompt", "response", "model", "tokens_in", "tokens_out", "latency_ms",
    "cost_usd", "user_id", "conversation_id", "source",
)
EVAL_COLUMNS = (
    "id", "completion_id", "eval_type", "score", "criteria", "explanation", "created_at", "source",
)


def _user(key: Column, users: int) -> Column:
    """One of `users` names, by key."""
    return F.format_string("user_%03d", (F.lit(1) + numbers.draw(key, "user", users)).cast("int"))


def winner_score(winner: Column, side: str) -> Column:
    """1 for the winning side, 0.5 for a tie, 0 otherwise (an unknown winner scores 0 twice)."""
    return F.when(winner == side, 1.0).when(winner == "tie", 0.5).otherwise(0.0)


def distinct_battles(battles: DataFrame, prefix: str = "lmsys_") -> DataFrame:
    """First battle per conversation in file order (`seq`); a missing id is made from the row."""
    named = battles.withColumn(
        "conversation_id",
        F.coalesce("conversation_id", F.concat(F.lit(prefix), F.col("seq").cast("string"))),
    )
    return cleaning.first_per_key(named, "conversation_id", "seq")


def battle_sides(battles: DataFrame, anchor, first_id: int = 0) -> DataFrame:
    """Two completions per battle with the preference score of each side.

    battles: the battle columns plus `seq`. Side B costs 0.8 of side A; both share tokens,
    latency and time. A missing cost is priced for model A.
    """
    key, anchor = F.col("conversation_id"), F.lit(anchor).cast("timestamp_ntz")
    filled = distinct_battles(battles).select(
        "seq",
        "conversation_id",
        "model_a",
        "model_b",
        F.coalesce("winner", F.lit("nan")).alias("winner"),
        F.coalesce("language", F.lit("nan")).alias("language"),
        cleaning.imputed_tokens_in(F.col("tokens_in"), key).alias("tokens_in"),
        cleaning.imputed_tokens_out(F.col("tokens_out"), key).alias("tokens_out"),
        F.coalesce("latency_ms", F.lit(500.0)).alias("latency_ms"),
        F.col("cost_usd").alias("cost_usd"),
        cleaning.backfilled_time(F.col("timestamp"), key, anchor).alias("timestamp"),
    )
    priced = filled.withColumn(
        "cost_usd",
        F.coalesce(
            "cost_usd", pricing.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("model_a"))
        ),
    )
    title = F.concat(
        F.lit("["), F.col("language"), F.lit("] Arena battle: "), F.col("model_a"), F.lit(" vs "),
        F.col("model_b"),
    )

    def side(at: int, letter: str, share: float, suffix: str) -> Column:
        name = F.concat(F.col("conversation_id"), F.lit(suffix))
        return F.struct(
            (F.lit(first_id) + F.col("seq") * 2 + at).cast("bigint").alias("id"),
            F.col(f"model_{letter}").alias("model"),
            (F.col("cost_usd") * share).alias("cost_usd"),
            name.alias("conversation_id"),
            _user(name, values.ARENA_USERS).alias("user_id"),
            winner_score(F.col("winner"), f"model_{letter}").alias("score"),
        )

    return priced.select(
        "timestamp",
        title.alias("prompt"),
        F.concat(F.lit("Winner: "), F.col("winner")).alias("response"),
        "tokens_in",
        "tokens_out",
        "latency_ms",
        F.lit(values.ARENA).alias("source"),
        F.inline(F.array(side(0, "a", 1.0, ""), side(1, "b", 0.8, "_b"))),
    )


def eval_id(completion_id: Column, eval_type: str) -> Column:
    """Score ids from completion ids: eight places per completion, one per score type."""
    return (completion_id * 8 + values.EVAL_TYPES.index(eval_type)).cast("bigint")


def completions_of(rows: DataFrame) -> DataFrame:
    return rows.select(*COMPLETION_COLUMNS)


def preference_evals(sides: DataFrame, created_at) -> DataFrame:
    return sides.select(
        eval_id(F.col("id"), values.PREFERENCE).alias("id"),
        F.col("id").alias("completion_id"),
        F.lit(values.PREFERENCE).alias("eval_type"),
        "score",
        F.lit(None).cast("string").alias("criteria"),
        F.lit(values.ARENA_EXPLANATION).alias("explanation"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.lit(values.PREFERENCE).alias("source"),
    )


def single_model_calls(battles: DataFrame, anchor, first_id: int = 0) -> DataFrame:
    """One completion per battle, for one of its two models chosen by the conversation id."""
    key = F.col("conversation_id")
    model = F.when(numbers.draw(key, "side", 2) == 0, F.col("model_a")).otherwise(F.col("model_b"))
    chosen = distinct_battles(battles, "conv_").select(
        (F.lit(first_id) + F.col("seq")).cast("bigint").alias("id"),
        "conversation_id",
        model.alias("model"),
        cleaning.imputed_tokens_in(F.col("tokens_in"), key).alias("tokens_in"),
        cleaning.imputed_tokens_out(F.col("tokens_out"), key).alias("tokens_out"),
        F.coalesce("latency_ms", cleaning.imputed_latency(model, key)).alias("latency_ms"),
        "cost_usd",
        cleaning.backfilled_time(
            F.col("timestamp"), key, F.lit(anchor).cast("timestamp_ntz")
        ).alias("timestamp"),
    )
    return chosen.select(
        "id",
        "timestamp",
        F.concat(F.lit("[Conv "), key, F.lit("] User prompt")).alias("prompt"),
        F.concat(
            F.lit("[Model "), F.col("model"), F.lit("] Response to conversation "), key
        ).alias("response"),
        "model",
        "tokens_in",
        "tokens_out",
        "latency_ms",
        F.coalesce(
            "cost_usd", pricing.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("model"))
        ).alias("cost_usd"),
        _user(key, values.SINGLE_MODEL_USERS).alias("user_id"),
        "conversation_id",
        F.lit(values.ARENA).alias("source"),
    )


def benchmark_rows(rows: DataFrame, anchor, first_id: int = 0) -> DataFrame:
    """Completions of a benchmark file with rating, criteria and rater kept alongside."""
    at = times.before(
        F.lit(anchor).cast("timestamp_ntz"), numbers.draw(F.col("seq"), "hours", 73) * 3600
    )
    return rows.select(
        (F.lit(first_id) + F.col("seq")).cast("bigint").alias("id"),
        at.alias("timestamp"),
        "prompt",
        "response",
        F.lit(values.BENCHMARK_MODEL).alias("model"),
        text.tokens_as_words(F.col("prompt")).alias("tokens_in"),
        text.tokens_as_words(F.col("response")).alias("tokens_out"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(0.0).alias("cost_usd"),
        F.lit(values.BENCHMARK_USER).alias("user_id"),
        F.lit(None).cast("string").alias("conversation_id"),
        F.lit(values.BENCHMARK).alias("source"),
        cleaning.benchmark_rating(
            numbers.parse_float(F.col("quality_rating"), F.lit(None))
        ).alias("_human"),
        F.coalesce("criteria", F.lit(values.BENCHMARK_CRITERIA)).alias("_criteria"),
        F.concat(F.lit("Rated by: "), F.coalesce("human_rater", F.lit("?"))).alias("_explanation"),
    )


def _eval_rows(scored: DataFrame, parts: list[tuple], created_at) -> DataFrame:
    """Long-form scores from score columns; a missing score gives no row.

    parts: (eval_type, score, criteria, explanation, source).
    """
    entries = []
    for name, score, criteria, explanation, source in parts:
        entry = F.struct(
            eval_id(F.col("id"), name).alias("id"),
            F.col("id").alias("completion_id"),
            F.lit(name).alias("eval_type"),
            score.alias("score"),
            criteria.cast("string").alias("criteria"),
            explanation.cast("string").alias("explanation"),
            F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
            F.lit(source).alias("source"),
        )
        entries.append(F.when(score.isNotNull(), entry))
    return scored.select(F.inline(F.array_compact(F.array(*entries))))


def benchmark_evals(rows: DataFrame, created_at, stemming: bool = True) -> DataFrame:
    """BLEU, ROUGE-L and human score per benchmark completion."""
    scores = text_scores(rows, "id", stemming=stemming)
    kept = rows.select("id", "_human", "_criteria", "_explanation").join(scores, "id")
    none = F.lit(None)
    return _eval_rows(
        kept,
        [
            ("bleu", F.col("bleu"), none, none, "benchmark"),
            (
                "rouge",
                combined_rouge(F.col("rouge1"), F.col("rougeL"), "rougeL"),
                none,
                none,
                "benchmark",
            ),
            ("human", F.col("_human"), F.col("_criteria"), F.col("_explanation"), "benchmark"),
        ],
        created_at,
    )


def upload_rows(rows: DataFrame, source_id: str, uploaded_at, first_id: int = 0) -> DataFrame:
    """Completions of an uploaded file: blank pairs dropped, cells filled and typed.

    rows: text columns of the file plus `_seq`, the row order.
    """
    typed = cleaning.fill_upload_columns(cleaning.drop_blank_pairs(rows))
    return typed.select(
        (F.lit(first_id) + F.col("_seq")).cast("bigint").alias("id"),
        F.lit(uploaded_at).cast("timestamp_ntz").alias("timestamp"),
        "prompt",
        "response",
        "model",
        "tokens_in",
        "tokens_out",
        "latency_ms",
        "cost_usd",
        F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("conversation_id"),
        F.lit(source_id).alias("source"),
        cleaning.upload_rating(F.col("quality_rating")).alias("_human"),
        F.col("criteria").alias("_criteria"),
    )


def upload_evals(rows: DataFrame, created_at, stemming: bool = True) -> DataFrame:
    """BLEU, mean ROUGE and, where rated, the human score per uploaded completion."""
    scores = text_scores(rows, "id", stemming=stemming)
    kept = rows.select("id", "_human", "_criteria").join(scores, "id")
    none, criteria = F.lit(None), F.col("_criteria")
    return _eval_rows(
        kept,
        [
            ("bleu", F.col("bleu"), criteria, none, "computed"),
            ("rouge", combined_rouge(F.col("rouge1"), F.col("rougeL")), criteria, none, "computed"),
            ("human", F.col("_human"), none, none, "benchmark"),
        ],
        created_at,
    )


def long_scores(wide: DataFrame, id_column: str, score_columns: list[str]) -> DataFrame:
    """Score columns as (completion_id, eval_type, score) rows."""
    return wide.select(F.col(id_column).alias("completion_id"), *score_columns).unpivot(
        ["completion_id"], score_columns, "eval_type", "score"
    )


def expand_rating_tiers(prompts: DataFrame) -> DataFrame:
    """Rated benchmark rows from prompts with lists of answers per tier.

    prompts: prompt, criteria and the arrays excellent, mediocre, poor. The rating is a repeatable
    draw within the range of the tier, the rater a repeatable pick.
    """
    tiers = F.array(
        *[
            F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.col(name).alias("texts"))
            for name, low, high in values.RATING_TIERS
        ]
    )
    per_tier = prompts.select("prompt", "criteria", F.inline(tiers))
    rows = per_tier.select("prompt", "criteria", "low", "high", F.explode("texts").alias("_text"))
    key = F.concat(F.col("prompt"), F.lit("|"), F.col("_text"))
    digest = F.pmod(
        F.conv(F.substring(F.md5(F.concat(key, F.lit("|rating"))), 1, 8), 16, 10).cast("bigint"),
        F.col("high") - F.col("low") + 1,
    )
    raters = F.array(*[F.lit(name) for name in values.RATERS])
    return rows.select(
        "prompt",
        text.strip(F.col("_text")).alias("response"),
        (F.col("low") + digest).cast("int").alias("quality_rating"),
        "criteria",
        F.get(raters, numbers.draw(key, "rater", len(values.RATERS)).cast("int")).alias(
            "human_rater"
        ),
    )


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several inputs with the name of their source."""
    result = None
    for source, rows in parts.items():
        tagged = rows.withColumn("source", F.lit(source))
        result = tagged if result is None else result.unionByName(tagged)
    return result
