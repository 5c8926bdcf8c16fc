from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calltally.operators import metrics, rollups
from tests.conftest import NOW, dicts


def test_explicit_success_wins_over_tokens(make_calls):
    calls = make_calls([{"tokens_out": 0}, {"tokens_out": 0}, {}]).withColumn(
        "success", F.when(F.col("id") == 1, True).when(F.col("id") == 3, False)
    )
    (row,) = dicts(rollups.model_daily_performance(calls))
    assert (row["request_count"], row["success_count"], row["success_rate"]) == (3, 1, 33.33)


def test_user_days(make_calls):
    calls = make_calls(
        [{"user_id": "u", "model": m, "timestamp": NOW + timedelta(days=d)} for m, d in (("a", 0), ("a", 0), ("b", 0), ("a", 1))]
        + [{"user_id": None}]
    )
    rows = {r["date"].day: r for r in dicts(rollups.user_daily_usage(calls))}
    assert (rows[11]["request_count"], rows[11]["unique_models"], rows[11]["total_tokens"]) == (3, 2, 45)
    assert rows[12]["unique_models"] == 1 and len(rows) == 2


def test_model_stats_of_nothing(make_calls):
    got = {r["metric_name"]: r["metric_value"] for r in dicts(rollups.model_stats(make_calls([{}]), "none", NOW, NOW))}
    assert got == {"request_count": 0.0, "avg_latency": None, "total_cost": None, "success_rate": None}
    got = {r["metric_name"]: r["metric_value"] for r in dicts(rollups.model_stats(make_calls([{}, {"tokens_out": 0}]), "gpt-4", NOW, NOW))}
    assert got == {"request_count": 2.0, "avg_latency": 100.0, "total_cost": 0.02, "success_rate": 50.0}


def test_thresholds(make_calls):
    series = rollups.windowed_metrics(make_calls([{"latency_ms": 900.0}, {"tokens_out": 0, "model": "b"}]))
    rules = [("slow", "latency_ms", ">", 500.0, "warning"), ("failing", "error_rate_percent", ">=", 100.0, "critical")]
    rows = {r["alert_name"]: r for r in dicts(rollups.threshold_alerts(series, rules))}
    assert rows["slow"]["model"] == "gpt-4" and rows["slow"]["alert_type"] == "threshold"
    assert rows["failing"]["model"] == "b" and rows["failing"]["alert_type"] == "error_rate"
    assert rows["failing"]["triggered_at"] == datetime(2024, 6, 11, 13)
    with pytest.raises(ValueError):
        rollups.threshold_alerts(series, [("x", "latency_ms", "!=", 1.0, "info")])


def test_anomalies_need_history(make_calls):
    rows = [{"timestamp": NOW + timedelta(hours=h), "latency_ms": 100.0 + h % 2} for h in range(10)]
    rows.append({"timestamp": NOW + timedelta(hours=10), "latency_ms": 500.0})
    (row,) = dicts(rollups.anomaly_alerts(make_calls(rows)))
    assert (row["hour"], row["direction"], row["metric_value"]) == (NOW + timedelta(hours=10), "above", 500.0)


def test_traces(spark):
    rows = [
        ("r", None, "request", "root", NOW, NOW + timedelta(seconds=2), "ok"),
        ("a", "r", "span", "db", NOW, NOW + timedelta(milliseconds=250), "error"),
        ("b", "r", "span", "db", NOW, NOW + timedelta(milliseconds=750), "ok"),
        ("z", None, "request", "root", NOW, NOW, "ok"),
    ]
    traces = spark.createDataFrame(
        rows, "id string, parent_trace_id string, trace_type string, span_name string, start_time timestamp_ntz, end_time timestamp_ntz, status string"
    )
    roll = {r["span_name"]: r for r in dicts(rollups.trace_rollup(traces))}
    assert (roll["db"]["spans"], roll["db"]["errors"], roll["db"]["p95_duration_ms"]) == (2, 1, 725.0)
    kids = {r["id"]: (r["children"], r["child_ms"]) for r in dicts(rollups.child_counts(traces))}
    assert kids == {"r": (2, 1000.0), "z": (0, 0.0)}
    links = {r["id"]: r["parent_span"] for r in dicts(rollups.span_links(traces))}
    assert links == {"r": None, "z": None, "a": "root", "b": "root"}


def test_errors_by_code(make_calls):
    calls = make_calls([{"tokens_out": 0}, {"tokens_out": 0}, {}, {"model": "b"}]).withColumn(
        "error_code", F.when(F.col("id") == 1, "timeout").when(F.col("id") == 2, "limit")
    )
    rows = {r["error_code"]: (r["errors"], r["error_rate_percent"]) for r in dicts(metrics.error_breakdown(calls))}
    assert rows == {"timeout": (1, 33.33), "limit": (1, 33.33)}


@pytest.mark.parametrize("latency,band", [(199.9, "fast"), (200.0, "normal"), (500.0, "slow")])
def test_latency_bands(spark, latency, band):
    assert spark.range(1).select(metrics.latency_band(F.lit(latency))).first()[0] == band


@pytest.mark.parametrize("score,band", [(0.8, "high"), (0.6, "medium"), (0.59, "low")])
def test_score_bands(spark, score, band):
    assert spark.range(1).select(metrics.score_band(F.lit(score))).first()[0] == band


def test_silent_hours(make_calls):
    start = NOW.replace(minute=0, second=0, microsecond=0)
    busy = [h for h in range(12) if h not in (4, 6, 7, 8)]
    calls = [{"model": "a", "timestamp": start + timedelta(hours=h, minutes=m)} for h in busy for m in (5, 50)]
    calls += [{"model": None, "timestamp": start + timedelta(hours=h)} for h in (0, 1, 2, 3)]
    calls += [{"model": "rare", "timestamp": start}, {"model": "rare", "timestamp": start + timedelta(hours=11)}]
    rows = {r["model"]: r for r in dicts(rollups.silent_hours(make_calls(calls), hours=3))}
    # one silent hour is too short; before hour 6 lie 2, 0 and 2 calls
    assert set(rows) == {"a", None, "rare"}
    gap = rows["a"]
    assert (gap["started_at"], gap["ended_at"]) == (start + timedelta(hours=6), start + timedelta(hours=9))
    assert (gap["silent_hours"], gap["calls_before"], gap["hours_before"]) == (3, 4, 3)
    assert rows[None]["started_at"] == start + timedelta(hours=4) and rows[None]["ended_at"] is None
    assert rows["rare"]["silent_hours"] == 10
    later = rollups.silent_hours(make_calls(calls), hours=3, until=start + timedelta(hours=20))
    assert {(r["model"], r["ended_at"], r["silent_hours"]) for r in dicts(later) if r["ended_at"] is None} == {
        ("a", None, 9), (None, None, 17),  # one call in the three hours before is too few for "rare"
    }
    assert not dicts(rollups.silent_hours(make_calls(calls).where("false")))
