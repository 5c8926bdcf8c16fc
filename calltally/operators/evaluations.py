"""Scores joined to their completions: win rates, distributions, trends, dataset means.

Joins run on the completion id with only the needed columns on either side. No broadcast is
forced; a completion with very many scores is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers, times
from calltally.operators.filters import in_period, scoped
from calltally.operators.metrics import score_band


def scored_calls(evals: DataFrame, completions: DataFrame, *columns: str) -> DataFrame:
    """Scores with columns of their completion; scores without a completion drop out."""
    calls = completions.select(F.col("id").alias("_id"), *columns)
    slim = evals.select("completion_id", "eval_type", "score")
    return slim.join(calls, slim["completion_id"] == calls["_id"]).drop("_id")


def _outcomes() -> list[Column]:
    def scored(value: float) -> Column:
        return F.count(F.when(F.col("score") == value, 1))

    return [
        F.count(F.lit(1)).alias("battles"),
        scored(1.0).alias("wins"),
        scored(0.5).alias("ties"),
        scored(0.0).alias("losses"),
    ]


def _win_rates() -> list[Column]:
    wins_and_ties = F.col("wins") + F.col("ties") * 0.5
    return [
        F.round(numbers.ratio(F.col("wins").cast("double"), F.col("battles")), 4).alias("win_rate"),
        F.round(numbers.ratio(wins_and_ties, F.col("battles")), 4).alias("win_tie_rate"),
    ]


def model_comparison(
    evals: DataFrame, completions: DataFrame, start=None, end=None
) -> DataFrame:
    """Win, tie and loss counts with rates per model of the arena, best first."""
    calls = scoped(completions, start, end, values.ARENA)
    preferred = evals.where(F.col("eval_type") == values.PREFERENCE)
    return (
        scored_calls(preferred, calls, "model", "latency_ms", "cost_usd")
        .groupBy("model")
        .agg(
            *_outcomes(),
            F.avg("latency_ms").alias("latency"),
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
            F.count("cost_usd").alias("priced"),
        )
        .select("*", *_win_rates())
        .select(
            "model",
            "battles",
            "wins",
            "ties",
            "losses",
            "win_rate",
            F.round(F.col("win_rate") * 100, 1).alias("win_rate_pct"),
            "win_tie_rate",
            F.round(F.col("win_tie_rate") * 100, 1).alias("win_tie_rate_pct"),
            numbers.rounded(F.col("latency"), 2).alias("avg_latency_ms"),
            numbers.usd_mean(F.col("cost"), F.col("priced")).alias("avg_cost_usd"),
        )
        .orderBy(F.col("win_tie_rate").desc(), "model")
    )


def total_battles(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.coalesce(F.sum("battles"), F.lit(0)).alias("total_battles"))


def outcome_shares(comparison: DataFrame, by: str = "win_tie_rate_pct") -> DataFrame:
    """Win, tie and loss percentages per model, sorted by the chosen measure."""

    def share(count: str) -> Column:
        return numbers.percent(F.col(count), F.col("battles"), 0.0, 1)

    return comparison.select(
        "model",
        "battles",
        "win_rate_pct",
        "win_tie_rate_pct",
        share("wins").alias("win_pct"),
        share("ties").alias("tie_pct"),
        share("losses").alias("loss_pct"),
    ).orderBy(F.col(by).desc(), "model")


def quality_scores(comparison: DataFrame) -> DataFrame:
    """Model quality on a 0–10 scale."""
    return comparison.select(
        "model", F.round(F.col("win_tie_rate_pct") / 10, 1).alias("quality_score")
    )


def best_models(comparison: DataFrame, limit: int = 1) -> DataFrame:
    return comparison.orderBy(F.col("win_tie_rate").desc(), "model").limit(limit)


def eval_summary(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """Both sources side by side as (source, eval_type, metric, value).

    Only the arena's completion figures follow the period; score figures and the benchmark cover
    everything.
    """
    arena = (
        scoped(completions, start, end, values.ARENA)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("latency_ms").alias("latency"),
            F.count("latency_ms").alias("timed"),
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
        )
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("completions"),
            F.count("model").cast("double").alias("models"),
            numbers.rounded(
                numbers.ratio(F.sum("latency"), F.coalesce(F.sum("timed"), F.lit(0))), 2
            ).alias("avg_latency_ms"),
            F.coalesce(numbers.usd(F.sum("cost"), 4), F.lit(0.0)).alias("total_cost_usd"),
        )
    )
    arena_rows = arena.unpivot([], arena.columns, "metric", "value").select(
        F.lit(values.ARENA).alias("source"), F.lit("").alias("eval_type"), "metric", "value"
    )
    bench_count = completions.where(F.col("source") == values.BENCHMARK).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    bench_rows = bench_count.select(
        F.lit(values.BENCHMARK).alias("source"),
        F.lit("").alias("eval_type"),
        F.lit("completions").alias("metric"),
        "value",
    )
    both = completions.where(F.col("source").isin(values.ARENA, values.BENCHMARK))
    scored = (
        scored_calls(evals, both, "source")
        .where((F.col("source") == values.BENCHMARK) | (F.col("eval_type") == values.PREFERENCE))
        .groupBy("source", "eval_type")
        .agg(
            F.count(F.lit(1)).cast("double").alias("count"),
            numbers.rounded(F.avg("score"), 4).alias("avg"),
            numbers.rounded(F.min("score"), 4).alias("min"),
            numbers.rounded(F.max("score"), 4).alias("max"),
        )
        .unpivot(["source", "eval_type"], ["count", "avg", "min", "max"], "metric", "value")
        .where((F.col("source") == values.BENCHMARK) | (F.col("metric") == "count"))
    )
    return arena_rows.unionByName(bench_rows).unionByName(scored)


def _score_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        numbers.rounded(F.avg("score"), 4).alias("avg_score"),
        numbers.rounded(F.min("score"), 4).alias("min_score"),
        numbers.rounded(F.max("score"), 4).alias("max_score"),
    ]


def _in_scope(evals, completions, start, end, *columns) -> DataFrame:
    return scored_calls(evals, in_period(completions, start, end), *columns)


def scores_by_type(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    return (
        _in_scope(evals, completions, start, end).groupBy("eval_type").agg(*_score_stats())
    )


def score_histogram(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """Five buckets of scores; a bucket without scores is listed with 0."""
    scores = _in_scope(evals, completions, start, end).where(F.col("score").isNotNull())
    edges = [edge for _, edge in values.SCORE_BUCKETS]
    counts = []
    for at, (label, low) in enumerate(values.SCORE_BUCKETS):
        inside = F.lit(True) if low is None else F.col("score") >= low
        if at + 1 < len(edges):
            inside = inside & (F.col("score") < edges[at + 1])
        counts.append(F.count(F.when(inside, 1)).alias(label))
    labels = [label for label, _ in values.SCORE_BUCKETS]
    return scores.agg(*counts).unpivot([], [F.col(f"`{c}`") for c in labels], "range", "count")


def score_trend(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """Mean score and count per hour of the completion."""
    return (
        _in_scope(evals, completions, start, end, "timestamp")
        .groupBy(times.hour_of(F.col("timestamp")).alias("hour"))
        .agg(
            numbers.rounded(F.avg("score"), 4).alias("avg_score"), F.count(F.lit(1)).alias("count")
        )
        .orderBy("hour")
    )


def _pivoted(df: DataFrame, key: str) -> DataFrame:
    """Mean score per known type as columns; a type without scores stays null."""
    pivoted = df.groupBy(key).pivot("eval_type", list(values.EVAL_TYPES))
    return pivoted.agg(F.round(F.avg("score"), 4))


def model_type_scores(evals, completions, start=None, end=None) -> DataFrame:
    return _pivoted(_in_scope(evals, completions, start, end, "model"), "model")


def hour_type_scores(evals, completions, start=None, end=None) -> DataFrame:
    hourly = _in_scope(evals, completions, start, end, "timestamp").withColumn(
        "hour", times.hour_of(F.col("timestamp"))
    )
    return _pivoted(hourly, "hour").orderBy("hour")


def score_overall(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """Mean over all scores, null without any, and their number."""
    return _in_scope(evals, completions, start, end).agg(
        F.round(F.avg("score"), 4).alias("overall_avg_score"),
        F.count("score").alias("total_evals"),
    )


def win_rates(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """Win rates over every source, highest mean score first."""
    preferred = evals.where(F.col("eval_type") == values.PREFERENCE)
    return (
        _in_scope(preferred, completions, start, end, "model")
        .groupBy("model")
        .agg(*_outcomes(), F.avg("score").alias("mean"))
        .orderBy(F.col("mean").desc(), "model")
        .select("model", "battles", "wins", "ties", "losses", *_win_rates())
    )


def score_cube(evals: DataFrame, completions: DataFrame, start=None, end=None) -> DataFrame:
    """All score levels in one join: overall, per type, hour, model × type, hour × type.

    Rows are folded per (hour, model, type) first, so the level expansion touches few rows.
    """
    folded = (
        _in_scope(evals, completions, start, end, "timestamp", "model")
        .groupBy(times.hour_of(F.col("timestamp")).alias("hour"), "model", "eval_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("score").alias("scored"),
            F.sum("score").alias("total"),
            F.min("score").alias("low"),
            F.max("score").alias("high"),
        )
    )
    levels = [[], ["eval_type"], ["hour"], ["model", "eval_type"], ["hour", "eval_type"]]
    cube = folded.groupingSets(levels, "hour", "model", "eval_type").agg(
        F.grouping_id("hour", "model", "eval_type").alias("level"),
        F.sum("n").alias("count"),
        F.sum("scored").alias("scored"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return cube.select(
        F.col("level").cast("bigint").alias("level"),
        "hour",
        "model",
        "eval_type",
        "count",
        numbers.rounded(numbers.ratio(F.col("total"), F.col("scored")), 4).alias("avg_score"),
        numbers.rounded(F.col("low"), 4).alias("min_score"),
        numbers.rounded(F.col("high"), 4).alias("max_score"),
    )


def dataset_scores(evals: DataFrame, completions: DataFrame, source: str) -> DataFrame:
    """Mean score per type of one dataset."""
    return (
        scored_calls(evals, completions.where(F.col("source") == source))
        .groupBy("eval_type")
        .agg(F.round(F.avg("score"), 4).alias("avg_score"))
    )


def dataset_models(completions: DataFrame, source: str) -> DataFrame:
    return (
        completions.where(F.col("source") == source)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def dataset_listing(uploads: DataFrame, evals: DataFrame, completions: DataFrame) -> DataFrame:
    """Datasets, newest first, with their mean score per type, one row per type.

    One grouped join serves all datasets; a dataset without scores keeps one row.
    """
    means = (
        scored_calls(evals, completions, "source")
        .groupBy("source", "eval_type")
        .agg(F.round(F.avg("score"), 4).alias("avg_score"))
    )
    return (
        uploads.join(means, uploads["source_id"] == means["source"], "left")
        .drop("source")
        .orderBy(F.col("created_at").desc(), F.col("id").desc(), "eval_type")
    )


def load_report(evals: DataFrame, completions: DataFrame) -> DataFrame:
    """Rows stored: totals, per source and per score type, as (scope, key, count, avg_score).

    Each table is folded per key once; the totals are sums over that small result.
    """
    nothing = F.lit(None).cast("double")
    sources = completions.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    types = evals.groupBy("eval_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.count("score").alias("scored")
    )
    per_source = (
        sources.groupingSets([[], ["source"]], "source")
        .agg(F.grouping("source").alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
        .select(
            F.when(F.col("all") == 1, "completions").otherwise("source").alias("scope"),
            F.when(F.col("all") == 1, "").otherwise(F.col("source")).alias("key"),
            "count",
            nothing.alias("avg_score"),
        )
    )
    per_type = (
        types.groupingSets([[], ["eval_type"]], "eval_type")
        .agg(
            F.grouping("eval_type").alias("all"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
            (F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("mean"),
        )
        .select(
            F.when(F.col("all") == 1, "evals").otherwise("eval_type").alias("scope"),
            F.when(F.col("all") == 1, "").otherwise(F.col("eval_type")).alias("key"),
            "count",
            F.when(F.col("all") == 1, nothing).otherwise(F.round("mean", 3)).alias("avg_score"),
        )
    )
    return per_source.unionByName(per_type)


def score_bands(evals: DataFrame) -> DataFrame:
    return (
        evals.where(F.col("score").isNotNull())
        .groupBy("eval_type", score_band(F.col("score")).alias("band"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def rating_distribution(rows: DataFrame, rating: str) -> DataFrame:
    """Count per rating and per tier (from 8, 4–7, up to 3)."""
    counts = rows.groupBy(F.col(rating).cast("int").alias("rating")).agg(
        F.count(F.lit(1)).alias("count")
    )
    tier = F.lit(None).cast("string")
    for name, low, high in values.RATING_TIERS:
        tier = F.when(F.col("rating").between(low, high), name).otherwise(tier)
    per_rating = counts.select(
        F.lit("rating").alias("scope"), F.col("rating").cast("string").alias("key"), "count"
    )
    per_tier = (
        counts.withColumn("key", tier)
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum("count").alias("count"))
        .select(F.lit("tier").alias("scope"), "key", "count")
    )
    return per_rating.unionByName(per_tier)


def battle_report(battles: DataFrame) -> DataFrame:
    """Per first model of the battle file: mean latency, cost, wins, battles, win percentage."""
    wins = F.count(F.when(F.col("winner") == "model_a", 1))
    return (
        battles.groupBy("model_a")
        .agg(
            F.round(F.avg("latency_ms"), 2).alias("avg_latency"),
            F.round(F.sum("cost_usd"), 4).alias("total_cost"),
            wins.alias("wins"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("win_rate", F.round(100.0 * F.col("wins") / F.col("total"), 1))
    )
