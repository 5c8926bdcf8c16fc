"""Data contracts: row rules, batch acceptance, audits, key and reference checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values


def completion_rules() -> dict[str, Column]:
    """Contract of one logged call: what must hold, by the reason given when it does not."""
    return {
        "prompt missing": F.col("prompt").isNotNull(),
        "response missing": F.col("response").isNotNull(),
        "model missing": F.col("model").isNotNull(),
        "tokens_in must be > 0": F.col("tokens_in") > 0,
        "tokens_out must be > 0": F.col("tokens_out") > 0,
        "latency_ms must be > 0": F.col("latency_ms") > 0,
        "cost_usd must be >= 0": F.col("cost_usd") >= 0,
    }


def eval_rules() -> dict[str, Column]:
    """Contract of one score."""
    return {
        "score must lie in 0..1": F.col("score").between(0, 1),
        "unknown eval_type": F.col("eval_type").isin(*values.EVAL_TYPES),
    }


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add `reasons`, the list of broken rules; a rule that cannot be decided is broken."""
    broken = [
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for reason, holds in rules.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def keeps(rules: Mapping[str, Column]) -> Column:
    """Whether a row keeps every rule; cheaper than listing what it breaks."""
    kept = F.lit(True)
    for holds in rules.values():
        kept = kept & F.coalesce(holds, F.lit(False))
    return kept


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their reasons."""
    kept = keeps(rules)
    return df.where(kept), with_reasons(df.where(~kept), rules)


def batch_status(df: DataFrame, batch: str, rules: Mapping[str, Column]) -> DataFrame:
    """Per batch: size, failed items and whether it is taken.

    More than 1 000 items refuse the batch; more than 50 failures roll it back.
    """
    counted = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count(F.when(~keeps(rules), 1)).alias("failed_count"),
    )
    status = (
        F.when(F.col("item_count") > values.MAX_BATCH_ITEMS, "refused")
        .when(F.col("failed_count") > values.MAX_BATCH_FAILURES, "rollback")
        .otherwise("success")
    )
    return counted.withColumn("status", status).withColumn(
        "ingested_count",
        F.when(F.col("status") == "success", F.col("item_count") - F.col("failed_count")).otherwise(
            F.lit(0).cast("bigint")
        ),
    )


def accept_batches(
    df: DataFrame, batch: str, rules: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to store, rejected items with reasons, and the status per batch.

    An oversized batch may be arbitrarily large; it is dropped by the join with the taken
    batches, whose skewed partitions adaptive execution splits.
    """
    status = batch_status(df, batch, rules)
    valid, broken = split_valid(df, rules)
    taken = status.where(F.col("status") == "success").select(batch)
    good = valid.join(taken, batch, "left_semi")
    reported = status.where(F.col("status") != "refused").select(batch)
    bad = broken.join(reported, batch, "left_semi")
    return good, bad, status


def audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule in one scan; a null outcome passes, as in a CHECK constraint."""
    counted = df.agg(
        *[
            F.count(F.when(~F.coalesce(holds, F.lit(True)), 1)).alias(name)
            for name, holds in rules.items()
        ]
    )
    return counted.unpivot([], list(rules), "rule", "violations")


def completion_checks() -> dict[str, Column]:
    return {
        "tokens_not_negative": (F.col("tokens_in") >= 0) & (F.col("tokens_out") >= 0),
        "latency_not_negative": F.col("latency_ms") >= 0,
        "cost_not_negative": F.col("cost_usd") >= 0,
        "temperature_in_range": F.col("temperature").isNull() | F.col("temperature").between(0, 2),
    }


def trace_checks() -> dict[str, Column]:
    return {"end_after_start": F.col("end_time") >= F.col("start_time")}


def eval_checks() -> dict[str, Column]:
    return {
        "score_in_range": F.col("score").isNull() | F.col("score").between(0, 1),
        "raw_score_not_negative": F.col("raw_score").isNull() | (F.col("raw_score") >= 0),
    }


def metric_checks() -> dict[str, Column]:
    return {
        "min_not_above_max": F.col("metric_value").isNull()
        | F.col("min_value").isNull()
        | (F.col("min_value") <= F.col("max_value"))
    }


def alert_checks() -> dict[str, Column]:
    return {
        "resolved_after_triggered": F.col("resolved_at").isNull()
        | (F.col("resolved_at") >= F.col("triggered_at"))
    }


def user_checks() -> dict[str, Column]:
    return {"email_shape": F.col("email").rlike(values.EMAIL_PATTERN)}


def orphan_evals(evals: DataFrame, completions: DataFrame) -> DataFrame:
    """Scores whose completion does not exist."""
    ids = completions.select(F.col("id").alias("_id"))
    return evals.join(ids, evals["completion_id"] == ids["_id"], "left_anti")


def battle_checks(languages: Sequence[str]) -> dict[str, Column]:
    """Rules of the battle dataset that one row can decide."""
    present = [F.col(c).isNotNull() for c in ("conversation_id", "model_a", "model_b", "winner")]
    filled = present[0]
    for condition in present[1:]:
        filled = filled & condition
    return {
        "required_present": filled,
        "language_listed": F.col("language").isin(*languages),
        "winner_listed": F.col("winner").isin("model_a", "model_b", "tie"),
        "latency_positive": F.col("latency_ms") > 0,
        "cost_positive": F.col("cost_usd") > 0,
        "tokens_positive": (F.col("tokens_in") > 0) & (F.col("tokens_out") > 0),
    }


def unlisted_models(df: DataFrame, models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model names in use that the model list does not hold, with their row counts."""
    used = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("model"))
    counted = used.groupBy("model").agg(F.count(F.lit(1)).alias("uses"))
    return counted.join(models.select("model").distinct(), "model", "left_anti")


def repeated_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(key.cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where((F.col("occurrences") > 1) & F.col("key").isNotNull())
        .select(F.lit(name).alias("key_name"), "key", "occurrences")
    )
