"""Queries for daily views, windowed metrics, alerts, traces and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltally import values
from calltally.functions import pricing, times
from calltally.operators import cleaning, metrics, quality, rollups, trees
from calltally.plans.inputs import LANGUAGES, battles, completions, evals, nested_traces, table, traces
from calltally.plans.registry import query
from calltally.plans.traffic import END, PERIOD, START
from calltally.plans.twins import (
    BATTLES_CTE,
    PRICE_CTE,
    TRACES_CTE,
    over,
    over_completions,
    over_evals,
    percent,
    usd,
    usd_mean,
    usd_total,
)

SUCCESS = "count(*) FILTER (WHERE success)"
DAILY_SQL = f"""SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS date, model,
  count(*) AS request_count, round(avg(latency_ms), 6) AS avg_latency, min(latency_ms) AS min_latency,
  max(latency_ms) AS max_latency, CAST({usd_total('cost_usd')} AS DOUBLE) AS total_cost,
  {SUCCESS} AS success_count, {percent(SUCCESS, 'count(*)')} AS success_rate,
  round(avg(tokens_in), 6) AS avg_prompt_tokens, round(avg(tokens_out), 6) AS avg_completion_tokens
FROM completions GROUP BY 1, 2"""


def daily_report(view):
    """The view with its day as text and unrounded means cut to 6 digits for comparison."""
    return view.withColumns(
        {
            "date": F.date_format("date", "yyyy-MM-dd"),
            "avg_latency": F.round("avg_latency", 6),
            "avg_prompt_tokens": F.round("avg_prompt_tokens", 6),
            "avg_completion_tokens": F.round("avg_completion_tokens", 6),
        }
    )


@query("ag11_model_daily_performance", over_completions(DAILY_SQL))
def _(spark, folder):
    return daily_report(rollups.model_daily_performance(completions(spark, folder)))


@query(
    "ag12_user_daily_usage",
    over_completions(
        f"""SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS date, user_id,
  count(*) AS request_count, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS total_tokens,
  CAST({usd_total('cost_usd')} AS DOUBLE) AS total_cost, count(DISTINCT model) AS unique_models,
  {percent(SUCCESS, 'count(*)')} AS success_rate
FROM completions WHERE user_id IS NOT NULL GROUP BY 1, 2"""
    ),
)
def _(spark, folder):
    view = rollups.user_daily_usage(completions(spark, folder))
    return view.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


STATS_WHERE = f"FROM completions WHERE model = 'gpt-4' AND {PERIOD}"


@query(
    "ag13_u1_model_stats",
    over_completions(
        f"""SELECT 'request_count' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value {STATS_WHERE}
UNION ALL SELECT 'avg_latency', round(avg(latency_ms), 6) {STATS_WHERE}
UNION ALL SELECT 'total_cost', CAST({usd_total('cost_usd')} AS DOUBLE) {STATS_WHERE}
UNION ALL SELECT 'success_rate', round({SUCCESS} / CAST(count(*) AS DOUBLE) * 100, 6) {STATS_WHERE}"""
    ),
)
def _(spark, folder):
    stats = rollups.model_stats(completions(spark, folder), "gpt-4", START, END)
    return stats.withColumn("metric_value", F.round("metric_value", 6))


def _metrics_cte() -> str:
    start = "date_trunc('hour', timestamp)"
    shared = f"model, {start} AS window_start, {start} + INTERVAL 1 HOUR AS window_end"
    tail = f"FROM completions GROUP BY model, {start}"
    failed = "count(*) FILTER (WHERE NOT success)"
    return f"""metrics AS (
  SELECT {shared}, 'latency_ms' AS metric_name, 'summary' AS metric_type,
    round(avg(latency_ms), 2) AS metric_value, min(latency_ms) AS min_value,
    max(latency_ms) AS max_value, round(avg(latency_ms), 2) AS avg_value {tail}
  UNION ALL SELECT {shared}, 'cost_usd', 'summary', {usd(usd_total('cost_usd'))}, min(cost_usd),
    max(cost_usd), {usd_mean('cost_usd')} {tail}
  UNION ALL SELECT {shared}, 'request_count', 'counter', CAST(count(*) AS DOUBLE), NULL, NULL, NULL {tail}
  UNION ALL SELECT {shared}, 'error_rate_percent', 'gauge', {percent(failed, 'count(*)', '0.0')},
    NULL, NULL, NULL {tail}
)"""


METRICS_CTE = _metrics_cte()
METRIC_COLUMNS = (
    "model, window_start, window_end, metric_name, metric_type, metric_value, min_value,"
    " max_value, avg_value"
)


@query("ag27_windowed_metrics", over_completions(f"SELECT {METRIC_COLUMNS} FROM metrics", METRICS_CTE))
def _(spark, folder):
    return rollups.windowed_metrics(completions(spark, folder))


ALERT_RULES = [
    ("slow model", "latency_ms", ">", 900.0, "warning"),
    ("very slow model", "latency_ms", ">=", 1200.0, "critical"),
    ("failing model", "error_rate_percent", ">", 30.0, "critical"),
    ("quiet model", "request_count", "<=", 1.0, "info"),
]
ALERTS_SQL = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS alert_name,
  '{'error_rate' if metric == 'error_rate_percent' else 'threshold'}' AS alert_type,
  '{severity}' AS severity, '{metric} {sign} {limit}' AS triggered_condition,
  CAST({limit} AS DOUBLE) AS threshold_value, metric_name, metric_value, model,
  window_end AS triggered_at FROM metrics WHERE metric_name = '{metric}' AND metric_value {sign} {limit}"""
    for name, metric, sign, limit, severity in ALERT_RULES
)


@query("ag28_threshold_alerts", over_completions(ALERTS_SQL, METRICS_CTE))
def _(spark, folder):
    return rollups.threshold_alerts(
        rollups.windowed_metrics(completions(spark, folder)), ALERT_RULES
    )


@query(
    "ag29_silent_hours",
    over_completions(
        """SELECT model, 'no_traffic' AS alert_type, min(hour) AS started_at, any_value(following) AS ended_at,
  count(*) AS silent_hours, arg_min(calls, hour)::BIGINT AS calls_before, arg_min(seen, hour) AS hours_before
FROM (
  SELECT model, hour, n, sum(n) OVER w AS calls, count(*) OVER w AS seen,
    sum(n) OVER (PARTITION BY model ORDER BY hour) AS run,
    min(hour) FILTER (WHERE n > 0) OVER (PARTITION BY model ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following
  FROM (
    SELECT s.model, s.hour, count(c.id) AS n
    FROM (SELECT model, unnest(generate_series(min(hour), (SELECT max(hour) FROM hours), INTERVAL 1 HOUR)) AS hour
          FROM hours GROUP BY model) s
    LEFT JOIN hours c ON c.model IS NOT DISTINCT FROM s.model AND c.hour = s.hour
    GROUP BY s.model, s.hour
  )
  WINDOW w AS (PARTITION BY model ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
) WHERE n = 0 GROUP BY model, run
HAVING count(*) >= 2 AND arg_min(calls, hour) >= arg_min(seen, hour)""",
        "hours AS (SELECT id, model, date_trunc('hour', timestamp) AS hour FROM completions WHERE timestamp IS NOT NULL)",
    ),
)
def _(spark, folder):
    return rollups.silent_hours(completions(spark, folder))


@query(
    "ag29_anomaly_alerts",
    over_completions(
        """SELECT model, hour, round(metric_value, 2) AS metric_value, round(m, 2) AS expected, 'anomaly' AS alert_type,
  CASE WHEN metric_value > m THEN 'above' ELSE 'below' END AS direction
FROM (SELECT *, count(metric_value) OVER w AS seen, avg(metric_value) OVER w AS m,
    stddev_samp(metric_value) OVER w AS s FROM hourly
  WINDOW w AS (PARTITION BY model ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
WHERE seen >= 6 AND abs(metric_value - m) > 2.0 * s""",
        """hourly AS (SELECT model, date_trunc('hour', timestamp) AS hour,
    avg(latency_ms) AS metric_value FROM completions GROUP BY 1, 2)""",
    ),
)
def _(spark, folder):
    return rollups.anomaly_alerts(completions(spark, folder))


TRACE_ROLLUP = over(
    """SELECT trace_type, span_name, count(*) AS spans,
  count(*) FILTER (WHERE status = 'error') AS errors, max(duration_ms) AS max_duration_ms,
  round(quantile_cont(duration_ms, 0.95), 2) AS p95_duration_ms
FROM timed GROUP BY 1, 2""",
    TRACES_CTE,
)


@query("ag30_trace_rollup", TRACE_ROLLUP)
def _(spark, folder):
    return rollups.trace_rollup(traces(spark, folder))


@query("ag30_trace_rollup_ranked", TRACE_ROLLUP)
def _(spark, folder):
    return rollups.trace_rollup(traces(spark, folder))


@query(
    "ag30_child_counts",
    over(
        """SELECT r.id, r.span_name, r.duration_ms, coalesce(c.children, 0) AS children,
  coalesce(c.child_ms, 0) AS child_ms
FROM (SELECT * FROM timed WHERE parent_trace_id IS NULL) r LEFT JOIN (
  SELECT parent_trace_id, count(*) AS children, sum(duration_ms) AS child_ms
  FROM timed WHERE parent_trace_id IS NOT NULL GROUP BY 1) c ON c.parent_trace_id = r.id""",
        TRACES_CTE,
    ),
)
def _(spark, folder):
    return rollups.child_counts(traces(spark, folder))


@query(
    "j6_span_links",
    """SELECT 'o' || o_orderkey AS id, NULL::VARCHAR AS parent_trace_id, o_orderpriority AS span_name,
  NULL::VARCHAR AS parent_span, NULL::VARCHAR AS parent_status FROM orders
UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey,
  'o' || l_orderkey, l_returnflag || l_linestatus, o_orderpriority,
  CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'ok' END
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NOT NULL
UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey,
  'o' || l_orderkey, l_returnflag || l_linestatus, NULL, NULL
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def _(spark, folder):
    return rollups.span_links(traces(spark, folder))


@query(
    "cl17_generated_columns",
    over("SELECT id, duration_ms FROM timed", TRACES_CTE),
)
def _(spark, folder):
    duration = times.elapsed_ms(F.col("start_time"), F.col("end_time"))
    return traces(spark, folder).select("id", duration.alias("duration_ms"))


@query(
    "cl17_total_tokens",
    over_completions("SELECT id, tokens_in + tokens_out AS total_tokens FROM completions"),
)
def _(spark, folder):
    return cleaning.generated_columns(completions(spark, folder)).select("id", "total_tokens")


@query(
    "ag31_error_breakdown",
    over_completions(
        f"""SELECT c.model, c.error_code, count(*) AS errors,
  {percent('count(*)', 'any_value(m.calls)', '0.0')} AS error_rate_percent
FROM completions c JOIN (SELECT model, count(*) AS calls FROM completions GROUP BY model) m
  ON m.model = c.model WHERE NOT c.success GROUP BY c.model, c.error_code"""
    ),
)
def _(spark, folder):
    return metrics.error_breakdown(completions(spark, folder))


RAW_CTE = """raw AS (
  SELECT id, CAST(floor(id / 200) AS BIGINT) AS batch_id,
    CASE WHEN id % 41 <> 0 THEN prompt ELSE NULL END AS prompt,
    CASE WHEN id % 43 <> 0 THEN response ELSE '' END AS response,
    CASE WHEN id % 37 <> 0 THEN model END AS model,
    tokens_in - 3 AS tokens_in, tokens_out, latency_ms - 20 AS latency_ms, cost_usd - 0.0001 AS cost_usd
  FROM completions
),
judged AS (SELECT *, list_filter([
    CASE WHEN prompt IS NULL THEN 'prompt missing' END,
    CASE WHEN response IS NULL THEN 'response missing' END,
    CASE WHEN model IS NULL THEN 'model missing' END,
    CASE WHEN NOT coalesce(tokens_in > 0, false) THEN 'tokens_in must be > 0' END,
    CASE WHEN NOT coalesce(tokens_out > 0, false) THEN 'tokens_out must be > 0' END,
    CASE WHEN NOT coalesce(latency_ms > 0, false) THEN 'latency_ms must be > 0' END,
    CASE WHEN NOT coalesce(cost_usd >= 0, false) THEN 'cost_usd must be >= 0' END
  ], lambda r: r IS NOT NULL) AS reasons FROM raw)"""


def raw_calls(spark, folder):
    """Calls with missing texts and numbers moved below their legal minimum."""
    event = F.col("id")
    return completions(spark, folder).select(
        "id",
        F.floor(event / 200).cast("bigint").alias("batch_id"),
        F.when(event % 41 != 0, F.col("prompt")).alias("prompt"),
        F.when(event % 43 != 0, F.col("response")).otherwise("").alias("response"),
        F.when(event % 37 != 0, F.col("model")).alias("model"),
        (F.col("tokens_in") - 3).alias("tokens_in"),
        "tokens_out",
        (F.col("latency_ms") - 20).alias("latency_ms"),
        (F.col("cost_usd") - 0.0001).alias("cost_usd"),
    )


@query(
    "dq1_valid_calls",
    over_completions("SELECT id, model, tokens_in, tokens_out FROM judged WHERE len(reasons) = 0", RAW_CTE),
)
def _(spark, folder):
    valid, _ = quality.split_valid(raw_calls(spark, folder), quality.completion_rules())
    return valid.select("id", "model", "tokens_in", "tokens_out")


@query(
    "dq1_rejected_calls",
    over_completions(
        "SELECT id, array_to_string(reasons, '; ') AS reasons FROM judged WHERE len(reasons) > 0", RAW_CTE
    ),
)
def _(spark, folder):
    _, rejected = quality.split_valid(raw_calls(spark, folder), quality.completion_rules())
    return rejected.select("id", F.array_join("reasons", "; ").alias("reasons"))


def raw_evals(spark, folder):
    scores = evals(spark, folder)
    return scores.select(
        "id",
        F.when(F.col("id") % 23 == 0, "vibes").otherwise(F.col("eval_type")).alias("eval_type"),
        (F.col("score") * 1.25 - 0.0625).alias("score"),
    )


@query(
    "dq2_rejected_evals",
    over_evals(
        """SELECT id, eval_type, score, array_to_string(list_filter([
    CASE WHEN NOT coalesce(score BETWEEN 0 AND 1, false) THEN 'score must lie in 0..1' END,
    CASE WHEN eval_type NOT IN ('llm_judge', 'bleu', 'rouge', 'rules', 'human_preference', 'human')
      THEN 'unknown eval_type' END], lambda r: r IS NOT NULL), '; ') AS reasons
FROM raw WHERE NOT (score BETWEEN 0 AND 1) OR eval_type = 'vibes'""",
        """raw AS (SELECT id, CASE WHEN id % 23 = 0 THEN 'vibes' ELSE eval_type END AS eval_type,
    score * 1.25::DOUBLE - 0.0625::DOUBLE AS score FROM evals)""",
    ),
)
def _(spark, folder):
    _, rejected = quality.split_valid(raw_evals(spark, folder), quality.eval_rules())
    return rejected.select("id", "eval_type", "score", F.array_join("reasons", "; ").alias("reasons"))


STATUS_CTE = """status AS (
  SELECT batch_id, count(*) AS item_count, count(*) FILTER (WHERE len(reasons) > 0) AS failed_count,
    CASE WHEN count(*) > 1000 THEN 'refused'
      WHEN count(*) FILTER (WHERE len(reasons) > 0) > 50 THEN 'rollback' ELSE 'success' END AS status
  FROM sent GROUP BY batch_id)"""
# Every third call belongs to one oversized batch.
SENT_CTE = "sent AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN -1 ELSE batch_id END AS batch_id) FROM judged)"


def sent_calls(spark, folder):
    return raw_calls(spark, folder).withColumn(
        "batch_id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("batch_id"))
    )


@query(
    "dq3_batch_status",
    over_completions(
        """SELECT *, CASE WHEN status = 'success' THEN item_count - failed_count ELSE 0 END AS ingested_count
FROM status""",
        RAW_CTE,
        SENT_CTE,
        STATUS_CTE,
    ),
)
def _(spark, folder):
    return quality.batch_status(sent_calls(spark, folder), "batch_id", quality.completion_rules())


@query(
    "dq3_accepted_rows",
    over_completions(
        """SELECT id, batch_id FROM sent WHERE len(reasons) = 0
  AND batch_id IN (SELECT batch_id FROM status WHERE status = 'success')""",
        RAW_CTE,
        SENT_CTE,
        STATUS_CTE,
    ),
)
def _(spark, folder):
    good, _, _ = quality.accept_batches(
        sent_calls(spark, folder), "batch_id", quality.completion_rules()
    )
    return good.select("id", "batch_id")


@query(
    "dq3_reported_errors",
    over_completions(
        """SELECT id, batch_id, array_to_string(reasons, '; ') AS reasons FROM sent
WHERE len(reasons) > 0 AND batch_id IN (SELECT batch_id FROM status WHERE status <> 'refused')""",
        RAW_CTE,
        SENT_CTE,
        STATUS_CTE,
    ),
)
def _(spark, folder):
    _, bad, _ = quality.accept_batches(
        sent_calls(spark, folder), "batch_id", quality.completion_rules()
    )
    return bad.select("id", "batch_id", F.array_join("reasons", "; ").alias("reasons"))


def _violations(rule: str, holds: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({holds}, true)) AS violations"
        f" FROM {source}"
    )


@query(
    "dq4_completion_audit",
    over_completions(
        "\nUNION ALL ".join(
            [
                _violations("tokens_not_negative", "tokens_in >= 0 AND tokens_out >= 0", "raw"),
                _violations("latency_not_negative", "latency_ms >= 0", "raw"),
                _violations("cost_not_negative", "cost_usd >= 0", "raw"),
                _violations("temperature_in_range", "temperature BETWEEN 0 AND 2", "raw"),
            ]
        ),
        """raw AS (SELECT tokens_in - 3 AS tokens_in, tokens_out, latency_ms - 20 AS latency_ms,
    cost_usd - 0.0001 AS cost_usd, temperature FROM completions)""",
    ),
)
def _(spark, folder):
    raw = completions(spark, folder).select(
        (F.col("tokens_in") - 3).alias("tokens_in"),
        "tokens_out",
        (F.col("latency_ms") - 20).alias("latency_ms"),
        (F.col("cost_usd") - 0.0001).alias("cost_usd"),
        "temperature",
    )
    return quality.audit(raw, quality.completion_checks())


@query("dq4_trace_audit", over(_violations("end_after_start", "end_time >= start_time", "traces"), TRACES_CTE))
def _(spark, folder):
    return quality.audit(traces(spark, folder), quality.trace_checks())


@query(
    "dq4_eval_audit",
    over_evals(
        "\nUNION ALL ".join(
            [
                _violations("score_in_range", "score BETWEEN 0 AND 1", "raw"),
                _violations("raw_score_not_negative", "raw_score >= 0", "raw"),
            ]
        ),
        """raw AS (SELECT score * 1.25::DOUBLE - 0.0625::DOUBLE AS score, score * 10 - 1 AS raw_score
  FROM evals)""",
    ),
)
def _(spark, folder):
    raw = evals(spark, folder).select(
        (F.col("score") * 1.25 - 0.0625).alias("score"), (F.col("score") * 10 - 1).alias("raw_score")
    )
    return quality.audit(raw, quality.eval_checks())


@query(
    "dq4_metric_audit",
    over_completions(
        _violations("min_not_above_max", "min_value <= max_value", "metrics"), METRICS_CTE
    ),
)
def _(spark, folder):
    return quality.audit(
        rollups.windowed_metrics(completions(spark, folder)), quality.metric_checks()
    )


@query(
    "dq4_alert_audit",
    """SELECT 'resolved_after_triggered' AS rule, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS violations
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(spark, folder):
    raised = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("triggered_at")
    )
    resolved = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").alias("resolved_at")
    )
    alerts = resolved.join(raised, F.col("o_orderkey") == F.col("l_orderkey"))
    return quality.audit(alerts, quality.alert_checks())


@query(
    "dq4_user_audit",
    f"""SELECT 'email_shape' AS rule,
  count(*) FILTER (WHERE NOT regexp_matches(email, '{values.EMAIL_PATTERN}')) AS violations
FROM (SELECT replace(c_name, '#', '.') || CASE WHEN c_custkey % 7 = 0 THEN '#' ELSE '@' END
  || lower(c_mktsegment) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '.com' END AS email FROM customer)""",
)
def _(spark, folder):
    email = F.concat(
        F.replace("c_name", F.lit("#"), F.lit(".")),
        F.when(F.col("c_custkey") % 7 == 0, "#").otherwise("@"),
        F.lower("c_mktsegment"),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(".com"),
    )
    return quality.audit(
        table(spark, folder, "customer").select(email.alias("email")), quality.user_checks()
    )


@query(
    "dq6_battle_audit",
    over(
        "\nUNION ALL ".join(
            [
                _violations(
                    "required_present",
                    "conversation_id IS NOT NULL AND model_a IS NOT NULL AND model_b IS NOT NULL"
                    " AND winner IS NOT NULL",
                    "battles",
                ),
                _violations("language_listed", "language IN ('English', 'German', 'French')", "battles"),
                _violations("winner_listed", "winner IN ('model_a', 'model_b', 'tie')", "battles"),
                _violations("latency_positive", "latency_ms > 0", "battles"),
                _violations("cost_positive", "cost_usd > 0", "battles"),
                _violations("tokens_positive", "tokens_in > 0 AND tokens_out > 0", "battles"),
            ]
        ),
        BATTLES_CTE,
    ),
)
def _(spark, folder):
    return quality.audit(battles(spark, folder), quality.battle_checks(LANGUAGES))


@query(
    "dq6_unlisted_models",
    over(
        """SELECT model, count(*) AS uses FROM (SELECT model_a AS model FROM battles
  UNION ALL SELECT model_b FROM battles) WHERE model NOT IN (SELECT model FROM prices) GROUP BY model""",
        PRICE_CTE,
        BATTLES_CTE,
    ),
)
def _(spark, folder):
    return quality.unlisted_models(
        battles(spark, folder), pricing.price_table(spark), ["model_a", "model_b"]
    )


@query(
    "dq7_repeated_conversations",
    over(
        """SELECT 'conversation_id' AS key_name, conversation_id AS key, count(*) AS occurrences
FROM battles WHERE conversation_id IS NOT NULL GROUP BY conversation_id HAVING count(*) > 1""",
        BATTLES_CTE,
    ),
)
def _(spark, folder):
    return quality.repeated_keys(
        battles(spark, folder), F.col("conversation_id"), "conversation_id"
    )


@query(
    "dq7_repeated_users",
    """SELECT 'user_id' AS key_name, CAST(user_id AS VARCHAR) AS key, count(*) AS occurrences
FROM events GROUP BY user_id HAVING count(*) > 1""",
)
def _(spark, folder):
    return quality.repeated_keys(table(spark, folder, "events"), F.col("user_id"), "user_id")


NESTED_CTE = """spans AS (
  SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 1009 = 5 THEN 'o' || o_orderkey
      WHEN o_orderkey % 97 = 11 THEN 'x' || o_orderkey
      WHEN o_orderkey > 0 AND o_orderkey % 89 <> 3 THEN 'o' || (o_orderkey // 2) END AS parent, (o_custkey % 100) * 1000.0::DOUBLE AS ms
  FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '_' || l_linenumber, CASE WHEN l_linenumber > 1
      THEN 'l' || l_orderkey || '_' || (l_linenumber - 1) ELSE 'o' || l_orderkey END, min(l_quantity) * 1000.0::DOUBLE
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), below AS (SELECT parent, sum(ms) AS child_ms FROM spans WHERE parent <> id GROUP BY parent
), own AS (SELECT s.id, s.parent, s.ms, greatest(s.ms - coalesce(child_ms, 0), 0) AS self_ms FROM spans s LEFT JOIN below b ON b.parent = s.id
), walk AS (
  SELECT id, id AS root_id, 0 AS depth, self_ms AS path_ms, CASE WHEN parent IS NULL THEN 'root' ELSE 'orphan' END AS kind
  FROM own WHERE parent IS NULL OR parent NOT IN (SELECT id FROM own)
  UNION ALL SELECT o.id, w.root_id, w.depth + 1, w.path_ms + o.self_ms, 'span' FROM own o JOIN walk w ON o.parent = w.id
), paths AS (
  SELECT o.id, root_id, depth::BIGINT AS depth, ms AS duration_ms, self_ms, path_ms, coalesce(kind, 'cycle') AS kind
  FROM own o LEFT JOIN walk USING (id)
)"""


@query("ag30_span_paths", f"WITH RECURSIVE {NESTED_CTE} SELECT * FROM paths")
def _(spark, folder):
    return trees.span_paths(nested_traces(spark, folder))


@query(
    "ag30_trace_trees",
    f"""WITH RECURSIVE {NESTED_CTE} SELECT root_id, count(*) AS spans, max(depth) AS depth, sum(self_ms) AS self_ms,
  max(path_ms) AS critical_ms, CASE WHEN root_id IS NOT NULL THEN arg_min(id, (-path_ms, id)) END AS critical_end,
  CASE WHEN root_id IS NULL THEN 'cycle' WHEN bool_or(kind = 'orphan') THEN 'orphan' ELSE 'root' END AS kind
FROM paths GROUP BY root_id""",
)
def _(spark, folder):
    return trees.trace_trees(nested_traces(spark, folder))
