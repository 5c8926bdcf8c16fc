"""A daily view that merges: sums, extremes and sketches per day, source and model.

Users are kept as HyperLogLog sketches, latencies as KLL sketches, both built into Spark. Any period of
whole days, any source and model is answered by merging rows of the view; completions are not read.

Counts, sums and extremes are exact. Users are off by at most `USERS_ERROR` of their number (three
standard deviations of 1.04 / sqrt(2 ** lg_k)), and the rank of a quantile by at most `RANK_ERROR`
(the 99 % bound that the library states for its k); merging leaves both bounds as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers
from calltally.operators.metrics import QUANTILES

LG_K = 14
USERS_ERROR = 0.025
KLL_K = 1600
RANK_ERROR = 0.003
SUMS = ("requests", "cost", "latency", "timed", "ok", "tokens")


def daily_sketches(completions: DataFrame) -> DataFrame:
    """One row for each day, source and model. Rows without a timestamp fall under a null day."""
    return completions.groupBy(F.to_date("timestamp").alias("date"), "source", "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.expr(f"coalesce({numbers.USD_TOTAL}, 0)").alias("cost"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency"),
        F.count("latency_ms").alias("timed"),
        F.count(F.when(F.col("tokens_out") > 0, 1)).alias("ok"),
        F.coalesce(F.sum(F.col("tokens_in").cast("bigint") + F.col("tokens_out")), F.lit(0)).alias("tokens"),
        F.min("latency_ms").alias("min_latency"), F.max("latency_ms").alias("max_latency"),
        F.hll_sketch_agg("user_id", F.lit(LG_K)).alias("users"),
        F.kll_sketch_agg_double("latency_ms", F.lit(KLL_K)).alias("latencies"),
    )


def refresh(completions: DataFrame, path: str, days: Sequence[str] | None = None) -> None:
    """Build the view, or with `days` only those days anew; each day is one folder that replaces itself."""
    if days:
        completions = completions.where(F.to_date("timestamp").isin(*[F.lit(d).cast("date") for d in days]))
    (
        daily_sketches(completions).repartition("date").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    )


def scoped(view: DataFrame, start=None, end=None, source: str | None = values.ARENA, model: str | None = None) -> DataFrame:
    """Rows of the days from `start` up to, without, `end`; the filter on days prunes folders."""
    for bound, fits in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") < d)):
        if bound is not None:
            if len(str(bound)) > 10 and str(bound)[11:].strip("0:."):
                raise ValueError(f"the view has whole days only: {bound}")
            view = view.where(fits(F.lit(str(bound)[:10]).cast("date")))
    if source is not None:
        view = view.where(F.col("source") == source)
    return view if model is None else view.where(F.col("model") == model)


def _users() -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("users_estimate")


def summary(view: DataFrame, start=None, end=None, source: str | None = values.ARENA, model: str | None = None) -> DataFrame:
    """One row: requests, cost, mean latency, tokens, success rate, and about how many users."""
    rows = scoped(view, start, end, source, model)
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], _users())
    return total.selectExpr(
        "requests AS total_requests", "cast(round(cost, 6) AS double) AS total_cost_usd",
        "round(CASE WHEN timed = 0 THEN 0D ELSE latency / timed END, 2) AS avg_latency_ms", "tokens AS total_tokens",
        numbers.percent_sql("ok", "requests", "success_rate_percent"), "users_estimate",
    )


def percentiles(view: DataFrame, start=None, end=None, source: str | None = values.ARENA, model: str | None = None) -> DataFrame:
    """One row: p50 to p99 within `RANK_ERROR`, and the exact extremes; zeros without calls."""
    merged = scoped(view, start, end, source, model).agg(
        F.kll_merge_agg_double("latencies", F.lit(KLL_K)).alias("all"), F.min("min_latency").alias("min"),
        F.max("max_latency").alias("max"), F.coalesce(F.sum("timed"), F.lit(0)).alias("timed"),
    )
    held = F.col("timed") > 0
    return merged.select(
        *[F.when(held, F.kll_sketch_get_quantile_double("all", F.lit(q))).otherwise(F.lit(0.0)).alias(name) for name, q in QUANTILES.items()],
        F.coalesce("min", F.lit(0.0)).alias("min"), F.coalesce("max", F.lit(0.0)).alias("max"),
    )


def by_model(view: DataFrame, start=None, end=None, source: str | None = values.ARENA) -> DataFrame:
    """Per model: requests, cost, success rate, the median and 95th percentile, and about how many users."""
    grouped = scoped(view, start, end, source).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.kll_merge_agg_double("latencies", F.lit(KLL_K)).alias("all"), _users()
    )
    held = F.col("timed") > 0
    return grouped.select(
        "model", "requests", F.round(F.col("cost"), 6).cast("double").alias("total_cost_usd"),
        numbers.percent(F.col("ok"), F.col("requests")).alias("success_rate_percent"),
        *[F.when(held, F.kll_sketch_get_quantile_double("all", F.lit(q))).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))],
        "users_estimate",
    )


def active_users(view: DataFrame, start=None, end=None, source: str | None = None) -> DataFrame:
    """Per day: requests, tokens and about how many users, over all models."""
    grouped = scoped(view, start, end, source).groupBy("date")
    return grouped.agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), _users())
