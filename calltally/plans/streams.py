"""Queries that run a stream over everything there is and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.operators import alerts
from calltally.plans.inputs import TABLES, completions, completions_from, evals_from
from calltally.plans.operations import RAW_CTE, raw_calls
from calltally.plans.registry import query
from calltally.plans.twins import over_completions, over_evals, percent, usd, usd_total
from calltally.session import scratch_path
from calltally.streaming import jobs

CLOSED = "(SELECT max(timestamp) - INTERVAL 1 HOUR FROM completions)"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.read_parquet_stream(spark, folder, "events.parquet", TABLES["events"])


def finished(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end and read its files."""
    root = scratch_path(spark, name)
    jobs.run_available(rows, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@query(
    "st1_ingest_accepted",
    over_completions("SELECT id, model, tokens_in, tokens_out FROM judged WHERE len(reasons) = 0", RAW_CTE),
)
def _(spark, folder):
    accepted, _ = _ingested(spark, folder)
    return accepted.select("id", "model", "tokens_in", "tokens_out")


@query(
    "st1_ingest_rejected",
    over_completions(
        "SELECT id, array_to_string(reasons, '; ') AS reasons FROM judged WHERE len(reasons) > 0", RAW_CTE
    ),
)
def _(spark, folder):
    _, rejected = _ingested(spark, folder)
    return rejected.select("id", F.array_join("reasons", "; ").alias("reasons"))


def _ingested(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    root = scratch_path(spark, "landing")
    raw_calls(spark, folder).drop("batch_id").write.json(f"{root}/in")
    calls = jobs.read_landing(spark, f"{root}/in")
    paths = f"{root}/accepted", f"{root}/rejected"
    jobs.ingest(calls, *paths, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(paths[0]), spark.read.parquet(paths[1])


HOUR = "date_trunc('hour', timestamp)"


@query(
    "st2_hourly_rollup",
    over_completions(
        f"""SELECT {HOUR} AS hour, model, count(*) AS requests, round(avg(latency_ms), 2) AS avg_latency_ms,
  round(quantile_disc(latency_ms, 0.5), 2) AS p50_approx,
  round(quantile_disc(latency_ms, 0.95), 2) AS p95_approx,
  {usd(usd_total('cost_usd'))} AS total_cost_usd,
  count(*) FILTER (WHERE tokens_out > 0) AS success_count
FROM completions GROUP BY 1, 2 HAVING {HOUR} + INTERVAL 1 HOUR <= {CLOSED}"""
    ),
)
def _(spark, folder):
    calls = completions_from(event_stream(spark, folder))
    return finished(spark, jobs.hourly_rollup(calls), "hourly")


@query("st3_distinct_conversations", over_completions("SELECT DISTINCT conversation_id FROM completions"))
def _(spark, folder):
    calls = completions_from(event_stream(spark, folder)).select("timestamp", "conversation_id")
    first = jobs.distinct_conversations(calls).select("conversation_id")
    return finished(spark, first, "distinct")


@query(
    "st4_sliding_alerts",
    over_completions(
        f"""SELECT * FROM (SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, model,
    count(*) AS requests, round(avg(latency_ms), 2) AS avg_latency_ms,
    {percent('count(*) FILTER (WHERE tokens_out <= 0)', 'count(*)', '0.0')} AS error_rate_percent
  FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTES, timestamp) - to_minutes(k * 15)
      FOR k IN [0, 1, 2, 3]]) AS window_start FROM completions) GROUP BY window_start, model)
WHERE window_end <= {CLOSED} AND (avg_latency_ms > 800 OR error_rate_percent > 30)"""
    ),
)
def _(spark, folder):
    calls = completions_from(event_stream(spark, folder))
    return finished(spark, jobs.sliding_alerts(calls, 800.0, 30.0), "sliding")


LIFE_RULES = [
    ("slow", "latency_ms", ">", 800.0, "warning"),
    ("failing", "error_rate_percent", ">", 10.0, "critical"),
    ("quiet", "request_count", "<=", 1.0, "info"),
]
_CROSSED = " UNION ALL ".join(
    f"""SELECT '{name}' AS alert_name, '{sign}' AS sign, '{severity}' AS severity, '{metric} {sign} {limit}' AS triggered_condition,
  model, window_end AS ended, {metric}::DOUBLE AS v FROM closed WHERE {metric} {sign} {limit}"""
    for name, metric, sign, limit, severity in LIFE_RULES
)
LIFE_CTE = f"""closed AS (SELECT * FROM (SELECT window_start + INTERVAL 1 HOUR AS window_end, model, count(*) AS request_count,
    round(avg(latency_ms), 2) AS latency_ms, {percent('count(*) FILTER (WHERE tokens_out <= 0)', 'count(*)', '0.0')} AS error_rate_percent
  FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTES, timestamp) - to_minutes(k * 15)
      FOR k IN [0, 1, 2, 3]]) AS window_start FROM completions) GROUP BY window_start, model) WHERE window_end <= {CLOSED}),
crossed AS ({_CROSSED}),
opening AS (SELECT *, CASE WHEN ended <= lag(ended) OVER (PARTITION BY alert_name, model ORDER BY ended) + INTERVAL 30 MINUTES
  THEN 0 ELSE 1 END AS opens FROM crossed),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY alert_name, model ORDER BY ended) AS place FROM opening)"""
LIFE_COLUMNS = (
    "alert_name", "model", "severity", "triggered_condition", "triggered_at", "resolved_at", "windows", "metric_value",
    "peak_value", "is_active", "is_resolved",
)
LIFE_SQL = """SELECT alert_name, model, severity, triggered_condition, min(ended) AS triggered_at,
  CASE WHEN max(ended) + INTERVAL 30 MINUTES < {until} THEN max(ended) + INTERVAL 30 MINUTES END AS resolved_at, count(*) AS windows,
  arg_min(v, ended) AS metric_value, CASE WHEN starts_with(sign, '>') THEN max(v) ELSE min(v) END AS peak_value,
  max(ended) + INTERVAL 30 MINUTES >= {until} AS is_active, max(ended) + INTERVAL 30 MINUTES < {until} AS is_resolved
FROM islands GROUP BY alert_name, model, severity, triggered_condition, sign, place"""


@query("st4_alert_lifecycle", over_completions(LIFE_SQL.format(until=CLOSED), LIFE_CTE))
def _(spark, folder):
    calls = completions_from(event_stream(spark, folder))
    with jobs.with_timers(spark):
        events = finished(spark, jobs.alert_lifecycle(jobs.crossings(calls, LIFE_RULES)), "alerts")
    at = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("triggered_at", "resolved_at")]
    rest = [c for c in LIFE_COLUMNS if not c.endswith("_at")]
    return alerts.standing(events).select(*rest, *at)


@query("ag28_alert_episodes", over_completions(LIFE_SQL.format(until="(SELECT max(ended) FROM crossed)"), LIFE_CTE))
def _(spark, folder):
    """The same alerts from the table, up to the last crossing of a closed window."""
    calls = completions(spark, folder)
    closed = calls.agg(F.max("timestamp") - F.expr("INTERVAL 1 HOUR")).scalar()
    crossed = jobs.crossings(calls, LIFE_RULES).withColumn("triggered_at", F.col("triggered_at").cast("timestamp_ntz"))
    return alerts.episodes(crossed.where(F.col("triggered_at") <= closed)).select(*LIFE_COLUMNS)


SESSIONS = f"""marked AS (SELECT user_id, timestamp, cost_usd,
    CASE WHEN timestamp >= lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) + INTERVAL 30 MINUTES
      OR lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp) IS NULL THEN 1 ELSE 0 END AS opens
  FROM completions WHERE user_id IS NOT NULL),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY timestamp) AS place FROM marked),
sessions AS (SELECT user_id, min(timestamp) AS session_start,
    max(timestamp) + INTERVAL 30 MINUTES AS session_end, count(*) AS requests,
    {usd(usd_total('cost_usd'))} AS total_cost_usd FROM numbered GROUP BY user_id, place)"""
SESSION_COLUMNS = "user_id, session_start, session_end, requests, total_cost_usd"


@query(
    "st5_user_sessions",
    over_completions(f"SELECT {SESSION_COLUMNS} FROM sessions WHERE session_end <= {CLOSED}", SESSIONS),
)
def _(spark, folder):
    calls = jobs.event_time(completions_from(event_stream(spark, folder)))
    return finished(spark, jobs.user_sessions(calls), "sessions")


@query("st5_user_sessions_of_table", over_completions(f"SELECT {SESSION_COLUMNS} FROM sessions", SESSIONS))
def _(spark, folder):
    calls = completions(spark, folder).withColumn("ts", F.col("timestamp").cast("timestamp"))
    return jobs.user_sessions(calls)


@query(
    "st6_scores_in_time",
    over_evals(
        """SELECT e.completion_id, c.model, e.eval_type, e.score FROM evals e
JOIN completions c ON c.id = e.completion_id
WHERE e.created_at BETWEEN c.timestamp AND c.timestamp + INTERVAL 1 HOUR"""
    ),
)
def _(spark, folder):
    calls = completions_from(event_stream(spark, folder))
    scores = evals_from(event_stream(spark, folder))
    return finished(spark, jobs.scores_in_time(calls, scores), "in_time")


@query(
    "st7_late_rows",
    over_completions(
        """SELECT CASE WHEN id % 2 = 1 AND timestamp <
    (SELECT max(timestamp) - INTERVAL 1 HOUR FROM completions WHERE id % 2 = 0)
  THEN 'late' ELSE 'on_time' END AS kind, count(*) AS rows FROM completions GROUP BY 1"""
    ),
)
def _(spark, folder):
    """Even calls arrive first, odd ones after; the odd ones behind the watermark are late."""
    root = scratch_path(spark, "late")
    landing, progress = f"{root}/in", f"{root}/progress"
    paths = f"{root}/on_time", f"{root}/late"
    calls = completions(spark, folder).select("id", "timestamp", "model")
    for part in (0, 1):
        calls.where(F.col("id") % 2 == part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(calls.schema).parquet(landing)
        jobs.split_late(stream, *paths, progress, f"{root}/checkpoint").awaitTermination()
    return jobs.late_counts(
        {"on_time": spark.read.parquet(paths[0]), "late": spark.read.parquet(paths[1])}
    )

