"""Queries over completions: scopes, listings, traffic, latency, cost and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltally import values
from calltally.functions import pricing, times
from calltally.operators import filters, metrics
from calltally.plans import twins
from calltally.plans.inputs import completions, table
from calltally.plans.registry import query
from calltally.plans.twins import OK, mean, over_completions, percent, quantile, usd, usd_mean, usd_total

START, END = "2024-01-08 00:00:00", "2024-01-15 12:00:00"
PERIOD = f"timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'"
ARENA = "source = 'lmsys'"

SUMMARY_SQL = f"""SELECT count(*) AS total_requests, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  {mean('latency_ms', 2)} AS avg_latency_ms,
  CAST(coalesce(sum(CAST(tokens_in AS BIGINT) + tokens_out), 0) AS BIGINT) AS total_tokens,
  coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models,
  {percent(OK, 'count(*)')} AS success_rate_percent,
  count(DISTINCT user_id) AS unique_users"""

QUANTILES_SQL = ", ".join(
    f"{quantile('latency_ms', share)} AS {name}" for name, share in metrics.QUANTILES.items()
)
PERCENTILES_SQL = f"""SELECT {QUANTILES_SQL}, round(coalesce(min(latency_ms), 0), 2) AS min,
  round(coalesce(max(latency_ms), 0), 2) AS max"""

BY_MODEL_SQL = f"""SELECT model, count(*) AS request_count, {mean('latency_ms', 2)} AS avg_latency_ms,
  {quantile('latency_ms', 0.5)} AS p50_latency_ms, {quantile('latency_ms', 0.95)} AS p95_latency_ms,
  {quantile('latency_ms', 0.99)} AS p99_latency_ms, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  {mean('tokens_in', 1)} AS avg_tokens_in, {mean('tokens_out', 1)} AS avg_tokens_out,
  {percent(OK, 'count(*)')} AS success_rate_percent
FROM completions WHERE {ARENA} GROUP BY model ORDER BY request_count DESC, model"""

BY_HOUR_SQL = f"""SELECT date_trunc('hour', timestamp) AS hour, count(*) AS requests,
  {usd_mean('cost_usd')} AS avg_cost_usd,
  {mean('latency_ms', 2)} AS avg_latency_ms, {quantile('latency_ms', 0.5)} AS p50,
  {quantile('latency_ms', 0.95)} AS p95, {quantile('latency_ms', 0.99)} AS p99,
  {OK} AS success_count, {mean('tokens_in', 1)} AS avg_tokens_in,
  {mean('tokens_out', 1)} AS avg_tokens_out
FROM completions WHERE {ARENA} GROUP BY 1 ORDER BY 1"""

IDS = "SELECT id, timestamp, model FROM completions WHERE "


@query("ag02_by_model", over_completions(BY_MODEL_SQL))
def _(spark, folder):
    return metrics.by_model(completions(spark, folder))


@query("ag02_by_model_ranked", over_completions(BY_MODEL_SQL))
def _(spark, folder):
    return metrics.by_model(completions(spark, folder))


@query("ag01_summary", over_completions(f"{SUMMARY_SQL} FROM completions WHERE {ARENA}"))
def _(spark, folder):
    return metrics.summary(completions(spark, folder))


@query(
    "ag01_summary_empty_period",
    over_completions(
        f"""{SUMMARY_SQL} FROM completions WHERE {ARENA}
  AND timestamp BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '1990-01-02'"""
    ),
)
def _(spark, folder):
    return metrics.summary(completions(spark, folder), "1990-01-01", "1990-01-02")


@query("ag03_by_hour", over_completions(BY_HOUR_SQL))
def _(spark, folder):
    return metrics.by_hour(completions(spark, folder))


@query("ag03_by_hour_ranked", over_completions(BY_HOUR_SQL))
def _(spark, folder):
    return metrics.by_hour(completions(spark, folder))


@query("ag04_percentiles", over_completions(f"{PERCENTILES_SQL} FROM completions WHERE {ARENA}"))
def _(spark, folder):
    return metrics.percentiles(completions(spark, folder))


@query(
    "ag04_percentiles_ranked",
    over_completions(f"{PERCENTILES_SQL} FROM completions WHERE {ARENA}"),
)
def _(spark, folder):
    return metrics.percentiles(completions(spark, folder))


@query(
    "ag04_percentiles_of_model",
    over_completions(f"{PERCENTILES_SQL} FROM completions WHERE {ARENA} AND model = 'gpt-4'"),
)
def _(spark, folder):
    return metrics.percentiles(completions(spark, folder), model="gpt-4")


@query(
    "ag05_approximate_percentiles",
    over_completions(
        f"""SELECT model, quantile, count(latency_ms) AS value_count, true AS keeps_bound
FROM completions, unnest(['p50', 'p75', 'p90', 'p95', 'p99']) AS t(quantile) WHERE {ARENA} GROUP BY model, quantile"""
    ),
)
def _(spark, folder):
    """The estimates differ between engines; their ranks must keep the bound in any."""
    return metrics.percentile_rank_errors(completions(spark, folder))


COST_SQL = f"""SELECT 'total' AS scope, '' AS key, {usd(usd_total('cost_usd'))} AS cost,
  {usd(usd_total('cost_usd'))} AS exact_cost FROM completions
UNION ALL SELECT 'model', model, {usd(usd_total('cost_usd'))}, {usd(usd_total('cost_usd'))}
  FROM completions GROUP BY model
UNION ALL SELECT 'hour', strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H:00:00'),
  round({usd_mean('cost_usd')} * count(*), 6),
  {usd(usd_total('cost_usd'))}
  FROM completions WHERE {ARENA} GROUP BY date_trunc('hour', timestamp)"""


@query("ag06_cost_breakdown", over_completions(COST_SQL))
def _(spark, folder):
    return metrics.cost_breakdown(completions(spark, folder))


SOURCE_SQL = f"""count(*) AS total_requests, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  {mean('latency_ms', 2)} AS avg_latency_ms, {percent(OK, 'count(*)')} AS success_rate_percent,
  count(DISTINCT model) AS model_count"""


@query(
    "ag07_by_source",
    over_completions(f"SELECT 'upload_a' AS source, {SOURCE_SQL} FROM completions WHERE source = 'upload_a'"),
)
def _(spark, folder):
    return metrics.by_source(completions(spark, folder), "upload_a")


@query(
    "ag07_unknown_source",
    over_completions(f"SELECT 'nobody' AS source, {SOURCE_SQL} FROM completions WHERE source = 'nobody'"),
)
def _(spark, folder):
    return metrics.by_source(completions(spark, folder), "nobody")


@query(
    "ag07_source_models",
    over_completions(
        f"""SELECT model, count(*) AS request_count, {mean('latency_ms', 2)} AS avg_latency_ms,
  {usd(usd_total('cost_usd'))} AS total_cost_usd
FROM completions WHERE source = 'evals_benchmark' GROUP BY model"""
    ),
)
def _(spark, folder):
    return metrics.source_models(completions(spark, folder), values.BENCHMARK)


@query(
    "ag07_all_sources",
    over_completions(
        f"""SELECT source, model, CAST(grouping(model) AS INT) AS is_source_row, {SOURCE_SQL}
FROM completions GROUP BY GROUPING SETS ((source), (source, model))"""
    ),
)
def _(spark, folder):
    return metrics.all_sources(completions(spark, folder))


@query(
    "ag18_arena_latency_spread",
    over_completions(
        f"""SELECT model, {mean('latency_ms', 2)} AS mean_latency, {quantile('latency_ms', 0.5)} AS median_latency,
  {usd_mean('cost_usd')} AS mean_cost
FROM completions GROUP BY model"""
    ),
)
def _(spark, folder):
    return metrics.model_spread(completions(spark, folder))


@query(
    "ag18_describe",
    over_completions(
        """SELECT count(latency_ms) AS count, round(avg(latency_ms), 4) AS mean,
  round(stddev_samp(latency_ms), 4) AS std, round(min(latency_ms), 4) AS min,
  round(quantile_cont(latency_ms, 0.25), 4) AS q25, round(quantile_cont(latency_ms, 0.5), 4) AS q50,
  round(quantile_cont(latency_ms, 0.75), 4) AS q75, round(max(latency_ms), 4) AS max FROM completions"""
    ),
)
def _(spark, folder):
    return metrics.describe(completions(spark, folder), "latency_ms")


@query(
    "ag19_by_user",
    over_completions(
        f"""SELECT user_id, count(*) AS request_count, {usd(usd_total('cost_usd'))} AS total_cost_usd,
  CAST(sum(CAST(tokens_in AS BIGINT) + tokens_out) AS BIGINT) AS total_tokens,
  {mean('latency_ms', 2)} AS avg_latency_ms
FROM completions WHERE user_id IS NOT NULL GROUP BY user_id"""
    ),
)
def _(spark, folder):
    return metrics.by_user(completions(spark, folder))


@query(
    "ag20_extended_summary",
    over_completions(
        f"""{SUMMARY_SQL}, {quantile('latency_ms', 0.5)} AS median_latency_ms,
  {quantile('latency_ms', 0.95)} AS p95_latency_ms, {quantile('latency_ms', 0.99)} AS p99_latency_ms,
  round(100 - {percent(OK, 'count(*)')}, 2) AS error_rate_percent
FROM completions WHERE {ARENA}"""
    ),
)
def _(spark, folder):
    return metrics.extended_summary(completions(spark, folder))


@query(
    "ag21_percentiles_with_spread",
    over_completions(
        f"""{PERCENTILES_SQL}, {mean('latency_ms', 2)} AS mean,
  round(coalesce(stddev_samp(latency_ms), 0), 2) AS stddev FROM completions WHERE {ARENA}"""
    ),
)
def _(spark, folder):
    return metrics.percentiles_with_spread(completions(spark, folder))


def _share_sql(key: str) -> str:
    return f"""SELECT {key}, {usd('cost')} AS amount,
  round(CAST(cost AS DOUBLE) / (SELECT CAST(sum(cost) AS DOUBLE) FROM grouped) * 100, 1) AS percent,
  request_count FROM grouped"""


def _grouped_sql(key: str) -> str:
    return f"""grouped AS (SELECT {key}, {usd_total('cost_usd')} AS cost, count(*) AS request_count
  FROM completions WHERE {key} IS NOT NULL GROUP BY {key})"""


@query("ag22_cost_share_by_model", over_completions(_share_sql("model"), _grouped_sql("model")))
def _(spark, folder):
    return metrics.cost_share(completions(spark, folder), "model")


@query("ag22_cost_share_by_user", over_completions(_share_sql("user_id"), _grouped_sql("user_id")))
def _(spark, folder):
    return metrics.cost_share(completions(spark, folder), "user_id")


@query(
    "ag23_extremes",
    over_completions(
        """SELECT model, request_count, total_cost_usd, avg_latency_ms,
  total_cost_usd = (SELECT min(total_cost_usd) FROM m) AS is_cheapest,
  total_cost_usd = (SELECT max(total_cost_usd) FROM m) AS is_dearest,
  avg_latency_ms = (SELECT min(avg_latency_ms) FROM m) AS is_fastest,
  avg_latency_ms = (SELECT max(avg_latency_ms) FROM m) AS is_slowest FROM m""",
        f"m AS ({BY_MODEL_SQL})",
    ),
)
def _(spark, folder):
    return metrics.extremes(completions(spark, folder))


@query(
    "ag24_series_totals",
    over_completions(
        """SELECT count(*) AS hours, CAST(sum(requests) AS BIGINT) AS requests,
  round(avg(requests), 1) AS mean_requests,
  CAST(sum(CAST(avg_cost_usd AS DECIMAL(18, 6))) AS DOUBLE) AS summed_mean_cost,
  CAST(sum(CAST(avg_tokens_in + avg_tokens_out AS DECIMAL(18, 1))) AS DOUBLE) AS summed_mean_tokens
FROM h""",
        f"h AS ({BY_HOUR_SQL})",
    ),
)
def _(spark, folder):
    return metrics.series_totals(completions(spark, folder))


def _tokens_sql(key: str, name: str) -> str:
    return over_completions(
        f"""SELECT {key} AS {name}, CAST(sum(tokens_in) AS BIGINT) AS sum_tokens_in,
  CAST(sum(tokens_out) AS BIGINT) AS sum_tokens_out,
  CAST(sum(CAST(tokens_in AS BIGINT) + tokens_out) AS BIGINT) AS sum_tokens,
  round(avg(CAST(tokens_in AS BIGINT) + tokens_out), 1) AS avg_tokens
FROM completions GROUP BY 1"""
    )


@query("ag32_tokens_by_model", _tokens_sql("model", "model"))
def _(spark, folder):
    return metrics.token_usage(completions(spark, folder), F.col("model"), "model")


@query("ag32_tokens_by_hour", _tokens_sql("date_trunc('hour', timestamp)", "hour"))
def _(spark, folder):
    return metrics.token_usage(
        completions(spark, folder), times.hour_of(F.col("timestamp")), "hour"
    )


@query("f1_period", over_completions(IDS + PERIOD))
def _(spark, folder):
    return filters.in_period(completions(spark, folder), START, END).select("id", "timestamp", "model")


@query(
    "f1_last_week",
    over_completions(IDS + f"timestamp >= TIMESTAMP '{END}' - INTERVAL 7 DAY AND timestamp <= TIMESTAMP '{END}'"),
)
def _(spark, folder):
    return filters.last_days(completions(spark, folder), END).select("id", "timestamp", "model")


@query("f2_source", over_completions(IDS + "source = 'upload_a'"))
def _(spark, folder):
    return filters.scoped(completions(spark, folder), source="upload_a").select("id", "timestamp", "model")


@query("f3_model", over_completions(IDS + "model = 'gpt-4'"))
def _(spark, folder):
    return filters.scoped(completions(spark, folder), model="gpt-4").select("id", "timestamp", "model")


@query("f4_models", over_completions(IDS + "model IN ('gpt-4', 'claude-3-opus')"))
def _(spark, folder):
    return filters.scoped(completions(spark, folder), models=["gpt-4", "claude-3-opus"]).select(
        "id", "timestamp", "model"
    )


@query(
    "f5_summary_of_user_and_model",
    over_completions(
        f"{SUMMARY_SQL} FROM completions WHERE {ARENA} AND model = 'gpt-4' AND user_id = 'user_7' AND {PERIOD}"
    ),
)
def _(spark, folder):
    return metrics.summary(completions(spark, folder), START, END, model="gpt-4", user_id="user_7")


@query("f6_known_users", over_completions("SELECT id, user_id FROM completions WHERE user_id IS NOT NULL"))
def _(spark, folder):
    return completions(spark, folder).where(F.col("user_id").isNotNull()).select("id", "user_id")


@query(
    "f7_between",
    over_completions(IDS + f"timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND tokens_in BETWEEN 10 AND 20"),
)
def _(spark, folder):
    inside = filters.in_period(completions(spark, folder), START, END)
    return inside.where(F.col("tokens_in").between(10, 20)).select("id", "timestamp", "model")


@query(
    "f8_point_lookup",
    over_completions("SELECT id, timestamp, prompt, model, tokens_in, cost_usd FROM completions WHERE id = 77"),
)
def _(spark, folder):
    return filters.by_id(completions(spark, folder), 77).select(
        "id", "timestamp", "prompt", "model", "tokens_in", "cost_usd"
    )


@query(
    "f10_json_attribute",
    """SELECT event_id, props FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 42""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "props")
    return filters.with_attribute(events, "props", "$.k", 42, "bigint")


LISTED = """id, CASE WHEN length(prompt) > 120 THEN substr(prompt, 1, 120) || '…' ELSE prompt END AS prompt,
  CASE WHEN length(response) > 120 THEN substr(response, 1, 120) || '…' ELSE response END AS response,
  model, tokens_in, tokens_out, latency_ms, cost_usd, user_id,
  strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp"""


@query("p1_log_rows", over_completions(f"SELECT {LISTED} FROM completions"))
def _(spark, folder):
    return filters.log_rows(completions(spark, folder))


@query(
    "p6_latency_bands",
    over_completions(
        """SELECT model, CASE WHEN latency_ms < 200 THEN 'fast' WHEN latency_ms < 500 THEN 'normal'
  ELSE 'slow' END AS band, count(*) AS count FROM completions GROUP BY 1, 2"""
    ),
)
def _(spark, folder):
    calls = completions(spark, folder)
    return calls.groupBy("model", metrics.latency_band(F.col("latency_ms")).alias("band")).agg(
        F.count(F.lit(1)).alias("count")
    )


@query(
    "p6_success_bands",
    over_completions(
        """SELECT user_id, success_rate_percent, CASE WHEN success_rate_percent >= 99 THEN 'good'
  WHEN success_rate_percent >= 95 THEN 'fair' ELSE 'poor' END AS band FROM u""",
        f"""u AS (SELECT user_id, {percent(OK, 'count(*)')} AS success_rate_percent
  FROM completions WHERE user_id IS NOT NULL GROUP BY user_id)""",
    ),
)
def _(spark, folder):
    return metrics.user_success(completions(spark, folder))


@query(
    "s3_newest_page",
    over_completions(f"SELECT {LISTED} FROM completions ORDER BY completions.timestamp DESC, id DESC LIMIT 50 OFFSET 100"),
)
def _(spark, folder):
    return filters.log_rows(filters.newest_first(completions(spark, folder), page=3, limit=50))


@query(
    "s3_next_page",
    over_completions(
        """SELECT id, timestamp, model FROM completions
WHERE (timestamp, id) < (TIMESTAMP '2024-01-15 12:00:00', 5000)
ORDER BY timestamp DESC, id DESC LIMIT 50"""
    ),
)
def _(spark, folder):
    return filters.next_page(completions(spark, folder), END, 5000).select("id", "timestamp", "model")


@query(
    "s3_page_count",
    over_completions(
        """SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages
FROM completions WHERE model = 'gpt-4' AND source = 'lmsys'"""
    ),
)
def _(spark, folder):
    return filters.page_count(
        filters.scoped(completions(spark, folder), source=values.ARENA, model="gpt-4"), 50
    )


@query(
    "s5_first_items",
    over_completions(IDS + "source = 'evals_benchmark' ORDER BY id LIMIT 20"),
)
def _(spark, folder):
    scope = filters.scoped(completions(spark, folder), source=values.BENCHMARK)
    return filters.first_items(scope, 20).select("id", "timestamp", "model")


@query(
    "s6_sample",
    over_completions(
        """SELECT id, model FROM (SELECT id, model, row_number() OVER (
    ORDER BY md5(CAST(id AS VARCHAR) || '|7'), id) AS place, count(*) OVER () AS total
  FROM completions) WHERE place <= greatest(1, CAST(floor(total * 0.1::DOUBLE) AS BIGINT))"""
    ),
)
def _(spark, folder):
    return filters.sample_rows(completions(spark, folder).select("id", "model"), 0.1, "7")


@query("src5_prices", f"WITH {twins.PRICE_CTE} SELECT e.event_id, p.model, p.ri AS price_in, p.ro AS price_out FROM events e JOIN prices p ON p.model = CASE e.event_type WHEN 'view' THEN 'gpt-4' WHEN 'click' THEN 'gpt-3.5-turbo' WHEN 'signup' THEN 'claude-3-opus' ELSE 'none' END")
def _(spark, folder):
    model = (
        F.when(F.col("event_type") == "view", "gpt-4")
        .when(F.col("event_type") == "click", "gpt-3.5-turbo")
        .when(F.col("event_type") == "signup", "claude-3-opus")
    )
    named = table(spark, folder, "events").select("event_id", model.alias("model"))
    return named.join(pricing.price_table(spark), "model")


@query(
    "src6_latency_ranges",
    over_completions(
        """SELECT c.model, coalesce(r.lo, 500) AS latency_low, coalesce(r.hi, 2000) AS latency_high,
  count(*) AS calls,
  count(*) FILTER (WHERE latency_ms BETWEEN coalesce(r.lo, 500) AND coalesce(r.hi, 2000)) AS inside
FROM completions c LEFT JOIN ranges r ON r.model = lower(c.model) GROUP BY 1, 2, 3""",
        twins.RANGE_CTE,
    ),
)
def _(spark, folder):
    low, high = pricing.latency_low(F.col("model")), pricing.latency_high(F.col("model"))
    ranged = completions(spark, folder).select(
        "model", "latency_ms", low.alias("latency_low"), high.alias("latency_high")
    )
    return ranged.groupBy("model", "latency_low", "latency_high").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(
            F.when(F.col("latency_ms").between(F.col("latency_low"), F.col("latency_high")), 1)
        ).alias("inside"),
    )


@query(
    "j2_price_lookup",
    over_completions(
        """SELECT c.id, c.model, coalesce(p.ri, 0.001::DOUBLE) AS price_in,
  coalesce(p.ro, 0.002::DOUBLE) AS price_out
FROM completions c LEFT JOIN prices p ON p.model = lower(c.model)"""
    ),
)
def _(spark, folder):
    calls = completions(spark, folder).select("id", "model")
    return pricing.with_prices(calls, pricing.price_table(spark))
