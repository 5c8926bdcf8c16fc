"""Traffic, latency, cost and usage over completions.

Result rows follow one policy: a missing sum or average counts as 0, an empty scope has a success
rate of 100, money is rounded to 6 digits, latency to 2, tokens to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers, times
from calltally.operators.filters import scoped
from calltally.operators.quantiles import (
    Part,
    approximate_quantiles,
    grouped_with_quantiles,
    rank_errors,
)

# The latency quantiles of the reports.
QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def pick(*names: str) -> dict[str, float]:
    return {name: QUANTILES[name] for name in names}


def succeeded(df: DataFrame) -> Column:
    """A call succeeded if it is marked so, or, without a mark, if it produced tokens."""
    produced = F.col("tokens_out") > 0
    return F.coalesce(F.col("success"), produced) if "success" in df.columns else produced


def _successes() -> Column:
    return F.count(F.when(F.col("tokens_out") > 0, 1))


def _range_report() -> list[str]:
    return [numbers.rounded_sql(name, 2) for name in (*QUANTILES, "min", "max")]


def summary(
    completions: DataFrame, start=None, end=None, source: str | None = values.ARENA, **scope
) -> DataFrame:
    """One row: requests, cost, latency, users, models and success rate.

    Rows are first folded per (model, user), which plain hash aggregation does before any
    shuffle. The users are counted from that small result; the sums and the list of models come from
    its rows folded again per model.
    """
    folded = (
        scoped(completions, start, end, source, **scope)
        .groupBy("model", "user_id")
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"{numbers.USD_TOTAL} AS cost"),
            F.expr("sum(latency_ms) AS latency"),
            F.expr("count(latency_ms) AS timed"),
            F.expr("count_if(tokens_out > 0) AS ok"),
            F.expr("sum(cast(tokens_in AS bigint) + tokens_out) AS tokens"),
        )
    )
    users = folded.agg(F.count_distinct("user_id")).scalar()
    per_model = folded.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("n", "cost", "latency", "timed", "ok", "tokens")]
    )
    total = per_model.agg(
        F.expr("coalesce(sum(n), 0) AS n"),
        F.expr("coalesce(sum(cost), 0) AS cost"),
        F.expr("sum(latency) AS latency"),
        F.expr("coalesce(sum(timed), 0) AS timed"),
        F.expr("coalesce(sum(ok), 0) AS ok"),
        F.expr("coalesce(sum(tokens), 0) AS tokens"),
        F.expr("array_join(sort_array(collect_list(nullif(model, ''))), ',') AS models"),
    )
    return total.withColumn("users", users).selectExpr(
        "n AS total_requests",
        "cast(round(cost, 6) AS double) AS total_cost_usd",
        "round(CASE WHEN timed = 0 THEN 0D ELSE latency / timed END, 2) AS avg_latency_ms",
        "tokens AS total_tokens",
        "models",
        numbers.percent_sql("ok", "n", "success_rate_percent"),
        "users AS unique_users",
    )


def extended_summary(
    completions: DataFrame, start=None, end=None, source: str | None = values.ARENA, **scope
) -> DataFrame:
    """`summary` plus median, p95, p99 and error rate."""
    latencies = percentiles(completions, start, end, source=source, **scope)
    row = latencies.select(F.struct("p50", "p95", "p99")).scalar()
    extended = summary(completions, start, end, source, **scope).withColumn("_latency", row)
    return extended.select(
        "*",
        F.col("_latency.p50").alias("median_latency_ms"),
        F.col("_latency.p95").alias("p95_latency_ms"),
        F.col("_latency.p99").alias("p99_latency_ms"),
        F.round(100 - F.col("success_rate_percent"), 2).alias("error_rate_percent"),
    ).drop("_latency")


def by_model(
    completions: DataFrame,
    start=None,
    end=None,
    source: str | None = values.ARENA,
) -> DataFrame:
    """Per model, most requests first."""
    shares = pick("p50", "p95", "p99")
    grouped = grouped_with_quantiles(
        scoped(completions, start, end, source),
        ["model"],
        _call_parts(),
        "latency_ms",
        shares,
    )
    return _call_averages(grouped).selectExpr(
        "model",
        "requests AS request_count",
        numbers.rounded_sql("avg_latency", 2, "avg_latency_ms"),
        *[numbers.rounded_sql(name, 2, f"{name}_latency_ms") for name in shares],
        "cast(round(cost, 6) AS double) AS total_cost_usd",
        numbers.rounded_sql("avg_tokens_in", 1),
        numbers.rounded_sql("avg_tokens_out", 1),
        numbers.percent_sql("success_count", "requests", "success_rate_percent"),
    ).orderBy(F.col("request_count").desc(), "model")


def _call_parts() -> list[Part]:
    return [
        ("requests", F.expr("count(1)"), "sum"),
        ("priced", F.expr("count(cost_usd)"), "sum"),
        ("cost", F.expr(numbers.USD_TOTAL), "sum"),
        ("latency", F.expr("sum(latency_ms)"), "sum"),
        ("timed", F.expr("count(latency_ms)"), "sum"),
        ("sum_in", F.expr("sum(tokens_in)"), "sum"),
        ("with_in", F.expr("count(tokens_in)"), "sum"),
        ("sum_out", F.expr("sum(tokens_out)"), "sum"),
        ("with_out", F.expr("count(tokens_out)"), "sum"),
        ("success_count", F.expr("count_if(tokens_out > 0)"), "sum"),
    ]


def _call_averages(grouped: DataFrame) -> DataFrame:
    return grouped.selectExpr(
        "*", "latency / nullif(timed, 0) AS avg_latency", "sum_in / nullif(with_in, 0) AS avg_tokens_in",
        "sum_out / nullif(with_out, 0) AS avg_tokens_out",
    )


def _spread_parts(column: str) -> list[Part]:
    """Count, sum, bounds and, from the buckets' own deviations and means, squared deviations."""
    value = F.col(column)
    return [
        ("count", F.count(value), "sum"),
        ("total", F.sum(value), "sum"),
        ("min", F.min(value), "min"),
        ("max", F.max(value), "max"),
        ("within", F.var_pop(value) * F.count(value), "sum"),
        ("squares", F.avg(value) * F.avg(value) * F.count(value), "sum"),
    ]


def _deviation() -> Column:
    apart = F.col("squares") - F.col("total") * F.col("total") / F.col("count")
    squared = F.greatest(F.lit(0.0), F.col("within") + apart)
    return F.when(F.col("count") > 1, F.sqrt(squared / (F.col("count") - 1)))


def by_hour(
    completions: DataFrame,
    start=None,
    end=None,
    source: str | None = values.ARENA,
) -> DataFrame:
    """Per hour that has requests, in time order."""
    shares = pick("p50", "p95", "p99")
    hourly = scoped(completions, start, end, source).withColumn(
        "hour", times.hour_of(F.col("timestamp"))
    )
    grouped = grouped_with_quantiles(
        hourly,
        ["hour"],
        _call_parts(),
        "latency_ms",
        shares,
    )
    return _call_averages(grouped).selectExpr(
        "hour",
        "requests",
        "coalesce(cast(round(cost / nullif(priced, 0), 6) AS double), 0D) AS avg_cost_usd",
        numbers.rounded_sql("avg_latency", 2, "avg_latency_ms"),
        *[numbers.rounded_sql(name, 2) for name in shares],
        "success_count",
        numbers.rounded_sql("avg_tokens_in", 1),
        numbers.rounded_sql("avg_tokens_out", 1),
    ).orderBy("hour")


def percentiles(
    completions: DataFrame,
    start=None,
    end=None,
    model: str | None = None,
    source: str | None = values.ARENA,
    **scope,
) -> DataFrame:
    """One row: p50 … p99, minimum and maximum latency, zeros when there is none."""
    grouped = grouped_with_quantiles(
        scoped(completions, start, end, source, model, **scope),
        [],
        [("min", F.min("latency_ms"), "min"), ("max", F.max("latency_ms"), "max")],
        "latency_ms",
        QUANTILES,
    )
    return grouped.selectExpr(*_range_report())


def percentiles_with_spread(
    completions: DataFrame, start=None, end=None, **scope
) -> DataFrame:
    """`percentiles` plus mean and standard deviation."""
    grouped = grouped_with_quantiles(
        scoped(completions, start, end, values.ARENA, **scope),
        [],
        _spread_parts("latency_ms"),
        "latency_ms",
        QUANTILES,
    )
    return grouped.select(
        "*", numbers.rounded(F.col("total") / F.col("count"), 2).alias("mean"),
        numbers.rounded(_deviation(), 2).alias("stddev"),
    ).selectExpr(*_range_report(), "mean", "stddev")


def model_spread(completions: DataFrame, start=None, end=None) -> DataFrame:
    """Per model over every source: mean and median latency, mean cost."""
    grouped = grouped_with_quantiles(
        scoped(completions, start, end),
        ["model"],
        [p for p in _call_parts() if p[0] in ("cost", "priced", "latency", "timed")],
        "latency_ms",
        {"median_latency": 0.5},
    )
    return grouped.select(
        "model", numbers.rounded(F.col("latency") / F.nullif("timed", F.lit(0)), 2).alias("mean_latency"),
        numbers.usd_mean(F.col("cost"), F.col("priced")).alias("mean_cost"),
        numbers.rounded(F.col("median_latency"), 2).alias("median_latency"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, deviation, minimum, quartiles and maximum of a column."""
    grouped = grouped_with_quantiles(
        df,
        [],
        _spread_parts(column),
        column,
        {"q25": 0.25, "q50": 0.5, "q75": 0.75},
    )
    return grouped.select(
        "*", (F.col("total") / F.nullif("count", F.lit(0))).alias("mean"), _deviation().alias("std")
    ).select(
        F.coalesce("count", F.lit(0)).alias("count"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


def side_by_side(completions: DataFrame, left: str, right: str) -> DataFrame:
    """Requests and mean latency of two sources in one row, from one scan."""

    def only(source: str, column: str) -> Column:
        return F.when(F.col("source") == source, F.col(column))

    return completions.where(F.col("source").isin(left, right)).agg(
        F.count(only(left, "id")).alias("left_requests"),
        F.count(only(right, "id")).alias("right_requests"),
        F.round(F.avg(only(left, "latency_ms")), 2).alias("left_latency_ms"),
        F.round(F.avg(only(right, "latency_ms")), 2).alias("right_latency_ms"),
    )


def user_success(completions: DataFrame) -> DataFrame:
    """Success rate per user with its band."""
    rate = (
        completions.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(numbers.percent(_successes(), F.count(F.lit(1))).alias("success_rate_percent"))
    )
    return rate.withColumn("band", success_band(F.col("success_rate_percent")))


def approximate_percentiles(
    completions: DataFrame, keys=("model",), source: str | None = values.ARENA, accuracy=10_000
) -> DataFrame:
    """Latency quantiles per key in bounded memory."""
    return approximate_quantiles(
        scoped(completions, source=source), list(keys), "latency_ms", QUANTILES, accuracy
    )


def percentile_rank_errors(
    completions: DataFrame, keys=("model",), source: str | None = values.ARENA, accuracy=10_000
) -> DataFrame:
    """Whether each quantile of `approximate_percentiles` keeps its bound on the rank."""
    return rank_errors(scoped(completions, source=source), list(keys), "latency_ms", QUANTILES, accuracy)


def cost_breakdown(completions: DataFrame, start=None, end=None) -> DataFrame:
    """Long form (scope, key, cost): total and per model over every source, per hour over one.

    All three come from one scan, folded per model, hour and source first.

    Hourly cost is the rounded mean times the requests, so hours need not add up to the total;
    `exact_cost` holds the unrounded-mean sum.
    """
    folded = (
        scoped(completions, start, end)
        .groupBy("model", times.hour_of(F.col("timestamp")).alias("hour"), F.col("source").eqNullSafe(values.ARENA).alias("arena"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count("cost_usd").alias("priced"),
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
        )
    )
    levels = folded.groupingSets([[], ["model"], ["hour", "arena"]], "model", "hour", "arena").agg(
        F.grouping("model").alias("no_model"),
        F.grouping("hour").alias("no_hour"),
        F.sum("requests").alias("requests"),
        F.sum("priced").alias("priced"),
        F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(28,8)")).alias("cost"),
    )
    hourly = F.round(numbers.usd_mean(F.col("cost"), F.col("priced")) * F.col("requests"), 6)
    is_hour, is_model = F.col("no_hour") == 0, F.col("no_model") == 0
    return levels.where(~is_hour | F.col("arena")).select(
        F.when(is_hour, "hour").when(is_model, "model").otherwise("total").alias("scope"),
        F.when(is_hour, F.date_format("hour", "yyyy-MM-dd'T'HH:00:00"))
        .when(is_model, F.col("model"))
        .otherwise("")
        .alias("key"),
        F.when(is_hour, hourly).otherwise(numbers.usd(F.col("cost"))).alias("cost"),
        numbers.usd(F.col("cost")).alias("exact_cost"),
    )


def by_source(completions: DataFrame, source: str, start=None, end=None) -> DataFrame:
    """One row for one source; an unknown source gives zeros and 100 percent."""
    return scoped(completions, start, end, source).groupBy("model").agg(
        *_source_sums()
    ).agg(
        F.lit(source).alias("source"),
        *_source_totals(),
        F.count_distinct("model").alias("model_count"),
    ).select("source", *_source_report(), "model_count")


def _source_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        numbers.usd_total(F.col("cost_usd")).alias("cost"),
        F.sum("latency_ms").alias("latency"),
        F.count("latency_ms").alias("timed"),
        _successes().alias("ok"),
    ]


def _source_totals() -> list[Column]:
    return [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(38,8)")).alias("cost"),
        F.sum("latency").alias("latency"),
        F.coalesce(F.sum("timed"), F.lit(0)).alias("timed"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"),
    ]


def _source_report() -> list[Column]:
    return [
        F.col("n").alias("total_requests"),
        numbers.usd(F.col("cost")).alias("total_cost_usd"),
        numbers.rounded(numbers.ratio(F.col("latency"), F.col("timed")), 2).alias("avg_latency_ms"),
        numbers.percent(F.col("ok"), F.col("n")).alias("success_rate_percent"),
    ]


def source_models(completions: DataFrame, source: str, start=None, end=None) -> DataFrame:
    """Per model of one source, most requests first."""
    return (
        scoped(completions, start, end, source)
        .groupBy("model")
        .agg(*_source_sums())
        .select(
            "model",
            F.col("n").alias("request_count"),
            numbers.rounded(numbers.ratio(F.col("latency"), F.col("timed")), 2).alias(
                "avg_latency_ms"
            ),
            numbers.usd(F.col("cost")).alias("total_cost_usd"),
        )
        .orderBy(F.col("request_count").desc(), "model")
    )


def all_sources(completions: DataFrame, start=None, end=None) -> DataFrame:
    """Every source and every model of it in one scan; `model` is null on the source's own row.

    The scan is folded per (source, model) first; both levels are sums over that small result.
    """
    folded = scoped(completions, start, end).groupBy("source", "model").agg(*_source_sums())
    return (
        folded.groupingSets([["source"], ["source", "model"]], "source", "model")
        .agg(
            F.grouping("model").cast("int").alias("is_source_row"),
            *_source_totals(),
            F.count_distinct("model").alias("model_count"),
        )
        .select("source", "model", "is_source_row", *_source_report(), "model_count")
    )


def by_user(completions: DataFrame, start=None, end=None, source: str | None = None) -> DataFrame:
    return (
        scoped(completions, start, end, source)
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            numbers.usd(numbers.usd_total(F.col("cost_usd"))).alias("total_cost_usd"),
            F.sum(F.col("tokens_in").cast("bigint") + F.col("tokens_out")).alias("total_tokens"),
            numbers.rounded(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        )
    )


def cost_share(completions: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Per key: cost, percent of the total, requests. The total is a scalar over the groups."""
    grouped = (
        scoped(completions, start, end)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
            F.count(F.lit(1)).alias("request_count"),
        )
    )
    total = grouped.agg(F.sum("cost").cast("double").alias("total")).scalar()
    return grouped.select(
        F.col(key),
        numbers.usd(F.col("cost")).alias("amount"),
        numbers.percent(F.col("cost").cast("double"), total, 0.0, 1).alias("percent"),
        "request_count",
    )


def token_usage(completions: DataFrame, key: Column, name: str, start=None, end=None) -> DataFrame:
    """Per key: summed and mean tokens."""
    both = F.col("tokens_in").cast("bigint") + F.col("tokens_out")
    return (
        scoped(completions, start, end)
        .groupBy(key.alias(name))
        .agg(
            F.sum("tokens_in").alias("sum_tokens_in"),
            F.sum("tokens_out").alias("sum_tokens_out"),
            F.sum(both).alias("sum_tokens"),
            numbers.rounded(F.avg(both), 1).alias("avg_tokens"),
        )
    )


def error_breakdown(completions: DataFrame) -> DataFrame:
    """Failed calls per model and error code with their share of the model's calls."""
    marked = completions.select("model", "error_code", succeeded(completions).alias("ok"))
    folded = marked.groupBy("model", "error_code").agg(
        F.count(F.when(~F.col("ok"), 1)).alias("errors"), F.count(F.lit(1)).alias("calls")
    )
    per_model = folded.groupBy("model").agg(F.sum("calls").alias("model_calls"))
    return (
        folded.where(F.col("errors") > 0)
        .join(per_model, "model")
        .select(
            "model",
            "error_code",
            "errors",
            numbers.percent(F.col("errors"), F.col("model_calls"), 0.0).alias("error_rate_percent"),
        )
    )


def latency_band(latency: Column) -> Column:
    """Below 200 ms is fast, below 500 ms is normal."""
    return F.when(latency < 200, "fast").when(latency < 500, "normal").otherwise("slow")


def success_band(rate: Column) -> Column:
    """From 99 percent good, from 95 percent fair."""
    return F.when(rate >= 99, "good").when(rate >= 95, "fair").otherwise("poor")


def score_band(score: Column) -> Column:
    """From 0.8 high, from 0.6 medium."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def extremes(completions: DataFrame, start=None, end=None) -> DataFrame:
    """Per model: cost and latency with flags for cheapest, dearest, fastest and slowest."""
    models = (
        scoped(completions, start, end, values.ARENA)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("request_count"), F.expr(f"{numbers.USD_TOTAL} AS cost"), F.avg("latency_ms").alias("latency"))
        .selectExpr(
            "model", "request_count", "cast(round(cost, 6) AS double) AS total_cost_usd",
            numbers.rounded_sql("latency", 2, "avg_latency_ms"),
        )
    )
    bounds = models.agg(
        F.struct(
            F.min("total_cost_usd").alias("cheap"),
            F.max("total_cost_usd").alias("dear"),
            F.min("avg_latency_ms").alias("fast"),
            F.max("avg_latency_ms").alias("slow"),
        ).alias("bounds")
    ).scalar()
    return models.withColumn("_b", bounds).select(
        *models.columns,
        (F.col("total_cost_usd") == F.col("_b.cheap")).alias("is_cheapest"),
        (F.col("total_cost_usd") == F.col("_b.dear")).alias("is_dearest"),
        (F.col("avg_latency_ms") == F.col("_b.fast")).alias("is_fastest"),
        (F.col("avg_latency_ms") == F.col("_b.slow")).alias("is_slowest"),
    )


def series_totals(completions: DataFrame, start=None, end=None) -> DataFrame:
    """Totals under the hourly charts: summed hourly mean cost, mean requests, summed mean tokens."""
    hourly = (
        scoped(completions, start, end, values.ARENA)
        .groupBy(times.hour_of(F.col("timestamp")).alias("hour"))
        .agg(*[part.alias(name) for name, part, _ in _call_parts()])
    )
    hourly = _call_averages(hourly).selectExpr(
        "requests", "coalesce(cast(round(cost / nullif(priced, 0), 6) AS double), 0D) AS avg_cost_usd",
        numbers.rounded_sql("avg_tokens_in", 1), numbers.rounded_sql("avg_tokens_out", 1),
    )
    return hourly.agg(
        F.count(F.lit(1)).alias("hours"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        numbers.rounded(F.avg("requests"), 1).alias("mean_requests"),
        F.sum(F.col("avg_cost_usd").cast("decimal(18,6)")).cast("double").alias("summed_mean_cost"),
        F.sum((F.col("avg_tokens_in") + F.col("avg_tokens_out")).cast("decimal(18,1)"))
        .cast("double")
        .alias("summed_mean_tokens"),
    )
