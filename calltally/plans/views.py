"""Queries that the mergeable view answers, held against exact figures from the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.operators import sketches
from calltally.plans.inputs import completions
from calltally.plans.registry import query
from calltally.plans.twins import over_completions, percent, usd, usd_total
from calltally.session import scratch_path

FROM, TO = "2024-01-05", "2024-01-25"
LATE = ("2024-01-07", "2024-01-08")
SCOPE = f"timestamp >= TIMESTAMP '{FROM} 00:00:00' AND timestamp < TIMESTAMP '{TO} 00:00:00'"
OK = "count(*) FILTER (WHERE tokens_out > 0)"


def view(spark: SparkSession, folder: str) -> DataFrame:
    """The stored view, first without some late rows, then refreshed for their days."""
    path = scratch_path(spark, "sketch-view")
    calls = completions(spark, folder)
    late = F.to_date("timestamp").isin(*LATE) & (F.col("id") % 3 == 0)
    sketches.refresh(calls.where(~late), path)
    sketches.refresh(calls, path, LATE)
    return spark.read.parquet(path)


def _in_scope(calls: DataFrame) -> DataFrame:
    return calls.where((F.col("timestamp") >= F.lit(FROM)) & (F.col("timestamp") < F.lit(TO)))


def _near(found: str, exact: str):
    return F.abs(F.col(found) - F.col(exact)) <= F.greatest(F.lit(1.0), sketches.USERS_ERROR * F.col(exact))


@query(
    "snk8_sketch_summary",
    over_completions(
        f"""SELECT count(*) AS total_requests, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  round(avg(latency_ms), 2) AS avg_latency_ms, sum(tokens_in + tokens_out)::BIGINT AS total_tokens,
  {percent(OK, 'count(*)')} AS success_rate_percent, true AS users_within
FROM completions WHERE {SCOPE} AND source = 'lmsys'"""
    ),
)
def _(spark, folder):
    exact = _in_scope(completions(spark, folder)).where("source = 'lmsys'").agg(F.count_distinct("user_id").alias("users"))
    found = sketches.summary(view(spark, folder), FROM, TO)
    return found.withColumn("users", exact.scalar()).withColumn("users_within", _near("users_estimate", "users")).drop("users", "users_estimate")


@query(
    "snk8_sketch_by_model",
    over_completions(
        f"""SELECT model, count(*) AS requests, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  {percent(OK, 'count(*)')} AS success_rate_percent, true AS p50_within, true AS p95_within, true AS users_within
FROM completions WHERE {SCOPE} GROUP BY model"""
    ),
)
def _(spark, folder):
    """The rank that each estimate really has among the calls, and the real number of users."""
    found = sketches.by_model(view(spark, folder), FROM, TO, source=None)
    ranked = _in_scope(completions(spark, folder)).join(found.select("model", "p50", "p95"), "model").groupBy("model").agg(
        F.count("latency_ms").alias("n"), F.count_distinct("user_id").alias("users"),
        *[F.count(F.when(F.col("latency_ms") <= F.col(p), 1)).alias(f"{p}_rank") for p in ("p50", "p95")],
    )
    slack = F.lit(sketches.RANK_ERROR) + 1 / F.col("n")
    return found.join(ranked, "model").select(
        "model", "requests", "total_cost_usd", "success_rate_percent",
        *[(F.abs(F.col(f"{p}_rank") / F.col("n") - q) <= slack).alias(f"{p}_within") for p, q in (("p50", 0.5), ("p95", 0.95))],
        _near("users_estimate", "users").alias("users_within"),
    )


@query(
    "snk8_sketch_percentiles",
    over_completions(
        f"SELECT min(latency_ms) AS min, max(latency_ms) AS max, true AS ordered, true AS p99_within FROM completions WHERE {SCOPE} AND source = 'lmsys' AND model = 'gpt-4'"
    ),
)
def _(spark, folder):
    found = sketches.percentiles(view(spark, folder), FROM, TO, model="gpt-4")
    calls = _in_scope(completions(spark, folder)).where("source = 'lmsys' AND model = 'gpt-4'")
    under = F.when(F.col("latency_ms") <= found.select("p99").scalar(), 1.0).otherwise(0.0)
    rising = F.array(F.col("min"), *[F.col(c) for c in sketches.QUANTILES], F.col("max"))
    ranked = found.withColumn("rank", calls.agg(F.avg(under)).scalar()).withColumn("n", calls.agg(F.count(F.lit(1))).scalar())
    return ranked.select(
        "min", "max", (F.array_sort(rising) == rising).alias("ordered"),
        (F.abs(F.col("rank") - 0.99) <= sketches.RANK_ERROR + 1 / F.col("n")).alias("p99_within"),
    )


@query(
    "snk8_sketch_active_users",
    over_completions(
        """SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS requests, sum(tokens_in + tokens_out)::BIGINT AS tokens,
  true AS users_within FROM completions GROUP BY 1"""
    ),
)
def _(spark, folder):
    found = sketches.active_users(view(spark, folder))
    exact = completions(spark, folder).groupBy(F.to_date("timestamp").alias("date")).agg(F.count_distinct("user_id").alias("users"))
    return found.join(exact, "date").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "requests", "tokens", _near("users_estimate", "users").alias("users_within")
    )
