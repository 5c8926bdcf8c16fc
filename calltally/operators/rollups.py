"""Daily views, windowed metrics, alerts and trace rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally.functions import numbers, times
from calltally.operators.filters import in_period
from calltally.operators.metrics import succeeded
from calltally.operators.quantiles import grouped_with_quantiles


def model_daily_performance(completions: DataFrame) -> DataFrame:
    marked = completions.withColumn("_ok", succeeded(completions))
    return (
        marked.groupBy(F.to_date("timestamp").alias("date"), "model")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.avg("latency_ms").alias("avg_latency"),
            F.min("latency_ms").alias("min_latency"),
            F.max("latency_ms").alias("max_latency"),
            numbers.usd_total(F.col("cost_usd")).cast("double").alias("total_cost"),
            F.count(F.when(F.col("_ok"), 1)).alias("success_count"),
            F.avg("tokens_in").alias("avg_prompt_tokens"),
            F.avg("tokens_out").alias("avg_completion_tokens"),
        )
        .withColumn(
            "success_rate", numbers.percent(F.col("success_count"), F.col("request_count"))
        )
    )


def user_daily_usage(completions: DataFrame) -> DataFrame:
    """Per day and user. Folding per model first makes the distinct count a plain count."""
    marked = completions.where(F.col("user_id").isNotNull()).withColumn(
        "_ok", succeeded(completions)
    )
    folded = marked.groupBy(F.to_date("timestamp").alias("date"), "user_id", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tokens_in").cast("bigint") + F.col("tokens_out")).alias("tokens"),
        numbers.usd_total(F.col("cost_usd")).alias("cost"),
        F.count(F.when(F.col("_ok"), 1)).alias("ok"),
    )
    return (
        folded.groupBy("date", "user_id")
        .agg(
            F.sum("n").alias("request_count"),
            F.sum("tokens").alias("total_tokens"),
            F.sum("cost").cast("double").alias("total_cost"),
            F.count("model").alias("unique_models"),
            F.sum("ok").alias("ok"),
        )
        .withColumn("success_rate", numbers.percent(F.col("ok"), F.col("request_count")))
        .drop("ok")
    )


def model_stats(completions: DataFrame, model: str, start, end) -> DataFrame:
    """Four (metric_name, metric_value) rows for one model and period from one scan."""
    calls = in_period(completions.where(F.col("model") == model), start, end)
    calls = calls.withColumn("_ok", succeeded(calls))
    total = calls.agg(
        F.count(F.lit(1)).cast("double").alias("request_count"),
        F.avg("latency_ms").alias("avg_latency"),
        F.sum(numbers.exact_usd(F.col("cost_usd"))).cast("double").alias("total_cost"),
        F.count(F.when(F.col("_ok"), 1)).alias("ok"),
    ).select(
        "request_count",
        "avg_latency",
        "total_cost",
        (F.col("ok") / F.nullif(F.col("request_count"), F.lit(0.0)) * 100).alias("success_rate"),
    )
    return total.unpivot([], total.columns, "metric_name", "metric_value")


def windowed_metrics(completions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Long-form metrics per window and model: latency, cost, requests and error rate."""
    calls = completions.select(
        "model",
        "latency_ms",
        "cost_usd",
        succeeded(completions).alias("_ok"),
        F.window("timestamp", width).alias("_w"),
    )
    grouped = calls.groupBy("_w", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~F.col("_ok"), 1)).alias("failed"),
        F.min("latency_ms").alias("low_latency"),
        F.max("latency_ms").alias("high_latency"),
        F.avg("latency_ms").alias("avg_latency"),
        F.min("cost_usd").alias("low_cost"),
        F.max("cost_usd").alias("high_cost"),
        numbers.usd_total(F.col("cost_usd")).alias("cost"),
    )
    nothing = F.lit(None).cast("double")

    def metric(name: str, kind: str, value: Column, low: Column, high: Column, mean: Column):
        return F.struct(
            F.lit(name).alias("metric_name"),
            F.lit(kind).alias("metric_type"),
            value.alias("metric_value"),
            low.alias("min_value"),
            high.alias("max_value"),
            mean.alias("avg_value"),
        )

    latency = F.round("avg_latency", 2)
    cost_mean = numbers.usd_mean(F.col("cost"), F.col("n"))
    rows = F.array(
        metric("latency_ms", "summary", latency, F.col("low_latency"), F.col("high_latency"), latency),
        metric(
            "cost_usd", "summary", numbers.usd(F.col("cost")), F.col("low_cost"), F.col("high_cost"),
            cost_mean,
        ),
        metric("request_count", "counter", F.col("n").cast("double"), nothing, nothing, nothing),
        metric(
            "error_rate_percent", "gauge", numbers.percent(F.col("failed"), F.col("n"), 0.0),
            nothing, nothing, nothing,
        ),
    )
    return grouped.select(
        "model",
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("_w.end").cast("timestamp_ntz").alias("window_end"),
        F.inline(rows),
    )


# Comparison signs a threshold rule may use.
COMPARISONS = (">", ">=", "<", "<=")


def threshold_alerts(metrics: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """Alert rows for windows whose metric crosses a threshold.

    rules: (alert_name, metric_name, comparison, threshold, severity). A rule list is a handful of
    literals, so every metric row checks it in place; no join takes part.
    """
    checked = []
    for name, metric_name, sign, threshold, severity in rules:
        if sign not in COMPARISONS:
            raise ValueError(f"unknown comparison: {sign}")
        value = F.col("metric_value")
        crossed = {
            ">": value > threshold, ">=": value >= threshold,
            "<": value < threshold, "<=": value <= threshold,
        }[sign]
        kind = "error_rate" if metric_name == "error_rate_percent" else "threshold"
        alert = F.struct(
            F.lit(name).alias("alert_name"),
            F.lit(kind).alias("alert_type"),
            F.lit(severity).alias("severity"),
            F.lit(f"{metric_name} {sign} {threshold}").alias("triggered_condition"),
            F.lit(float(threshold)).alias("threshold_value"),
        )
        checked.append(F.when((F.col("metric_name") == metric_name) & crossed, alert))
    alerts = metrics.select(
        "model",
        "metric_name",
        "metric_value",
        F.col("window_end").alias("triggered_at"),
        F.explode(F.array_compact(F.array(*checked))).alias("_alert"),
    )
    return alerts.select(
        "_alert.*", "metric_name", "metric_value", "model", "triggered_at"
    )


def anomaly_alerts(
    completions: DataFrame, hours: int = 24, deviations: float = 2.0, least: int = 6
) -> DataFrame:
    """Hours whose mean latency leaves the trailing mean ± k standard deviations of its model.

    The window runs over hourly aggregates, one row per model and hour.
    """
    hourly = completions.groupBy(
        "model", times.hour_of(F.col("timestamp")).alias("hour")
    ).agg(F.avg("latency_ms").alias("metric_value"))
    trailing = Window.partitionBy("model").orderBy("hour").rowsBetween(-hours, -1)
    judged = hourly.withColumns(
        {
            "_seen": F.count("metric_value").over(trailing),
            "_mean": F.avg("metric_value").over(trailing),
            "_spread": F.stddev_samp("metric_value").over(trailing),
        }
    )
    distance = F.abs(F.col("metric_value") - F.col("_mean"))
    return judged.where(
        (F.col("_seen") >= least) & (distance > F.lit(float(deviations)) * F.col("_spread"))
    ).select(
        "model",
        "hour",
        F.round("metric_value", 2).alias("metric_value"),
        F.round("_mean", 2).alias("expected"),
        F.lit("anomaly").alias("alert_type"),
        F.when(F.col("metric_value") > F.col("_mean"), "above").otherwise("below").alias("direction"),
    )


def hourly_spine(completions: DataFrame, until=None) -> DataFrame:
    """(model, hour, n): calls of every hour from a model's first call to `until`, hours without any included.

    `until` is the last hour, that of the latest call of any model by default. Calls are folded per model
    and hour first; each model's hours are then spelled out from its own first one, and both are added up.
    """
    hourly = completions.where(F.col("timestamp").isNotNull()).groupBy(
        "model", times.hour_of(F.col("timestamp")).alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    end = F.lit(until).cast("timestamp_ntz") if until is not None else hourly.agg(F.max("hour")).scalar()
    spelled = hourly.groupBy("model").agg(F.min("hour").alias("first")).select(
        "model", F.explode(F.sequence("first", F.greatest("first", end), F.expr("INTERVAL 1 HOUR"))).alias("hour"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return hourly.unionAll(spelled).groupBy("model", "hour").agg(F.sum("n").alias("n"))


def silent_hours(completions: DataFrame, hours: int = 24, least: int = 1, shortest: int = 2, until=None) -> DataFrame:
    """No-traffic alerts: runs of `shortest` hours or more without a call of a model that had calls before.

    A run counts if the `hours` hours before it, silent ones included, held `least` calls an hour on the
    mean. `ended_at` is the hour of the next call, null while the silence lasts. A model's window has one row
    an hour, so it grows with time, not with calls. Calls without a time are left out; null is a model too.
    """
    along = Window.partitionBy("model").orderBy("hour")
    before = along.rowsBetween(-hours, -1)
    placed = hourly_spine(completions, until).withColumns({
        "_calls": F.sum("n").over(before), "_hours": F.count("n").over(before),
        "_run": F.count(F.when(F.col("n") > 0, 1)).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.min(F.when(F.col("n") > 0, F.col("hour"))).over(along.rowsBetween(1, Window.unboundedFollowing)),
    })
    runs = placed.where("n = 0").groupBy("model", "_run").agg(
        F.min("hour").alias("started_at"), F.first("_next").alias("ended_at"), F.count(F.lit(1)).alias("silent_hours"),
        F.min_by("_calls", "hour").alias("calls_before"), F.min_by("_hours", "hour").alias("hours_before"),
    )
    counted = (F.col("silent_hours") >= shortest) & (F.col("calls_before") >= least * F.col("hours_before"))
    return runs.where(counted).select(
        "model", F.lit("no_traffic").alias("alert_type"), "started_at", "ended_at", "silent_hours",
        "calls_before", "hours_before",
    )


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Per trace type and span name: spans, errors, p95 duration."""
    timed = traces.withColumn(
        "duration_ms", times.elapsed_ms(F.col("start_time"), F.col("end_time"))
    )
    grouped = grouped_with_quantiles(
        timed,
        ["trace_type", "span_name"],
        [
            ("spans", F.count(F.lit(1)), "sum"),
            ("errors", F.count(F.when(F.col("status") == "error", 1)), "sum"),
            ("max_duration_ms", F.max("duration_ms"), "max"),
        ],
        "duration_ms",
        {"p95": 0.95},
    )
    return grouped.select(
        "trace_type", "span_name", "spans", "errors", "max_duration_ms",
        numbers.rounded(F.col("p95"), 2).alias("p95_duration_ms"),
    )


def child_counts(traces: DataFrame) -> DataFrame:
    """Every root span with the number of its children and their summed duration.

    Children are folded per parent before the join, so a parent with very many spans arrives as
    one row.
    """
    timed = traces.withColumn(
        "duration_ms", times.elapsed_ms(F.col("start_time"), F.col("end_time"))
    )
    children = (
        timed.where(F.col("parent_trace_id").isNotNull())
        .groupBy("parent_trace_id")
        .agg(F.count(F.lit(1)).alias("children"), F.sum("duration_ms").alias("child_ms"))
    )
    roots = timed.where(F.col("parent_trace_id").isNull()).select("id", "span_name", "duration_ms")
    return roots.join(children, roots["id"] == children["parent_trace_id"], "left").select(
        "id",
        "span_name",
        "duration_ms",
        F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("child_ms", F.lit(0.0)).alias("child_ms"),
    )


def span_links(traces: DataFrame) -> DataFrame:
    """Every span with the name and status of its parent; roots keep nulls."""
    parents = traces.select(
        F.col("id").alias("_parent"),
        F.col("span_name").alias("parent_span"),
        F.col("status").alias("parent_status"),
    )
    return traces.join(parents, traces["parent_trace_id"] == parents["_parent"], "left").select(
        "id", "parent_trace_id", "span_name", "parent_span", "parent_status"
    )
