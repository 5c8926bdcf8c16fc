"""Alerts from a table and from a stream against a plain walk over the windows."""

import random
from datetime import datetime, timedelta

import pytest

from calltally.operators import alerts
from calltally.streaming import jobs

START = datetime(2024, 3, 1)
STEP, QUIET = timedelta(minutes=15), timedelta(minutes=30)
RULES = [("slow", "latency_ms", ">", 100.0, "warning"), ("few", "request_count", "<=", 1.0, "info")]
CROSSED = (
    "alert_name string, alert_type string, severity string, triggered_condition string, threshold_value double,"
    " metric_name string, metric_value double, model string, triggered_at timestamp_ntz"
)


def crossed(windows):
    """(alert, model, window number, value) as rows of crossings."""
    sign = {name: s for name, _, s, _, _ in RULES}
    return [
        (name, "threshold", "info", f"m {sign[name]} 1", 1.0, "m", value, model, START + k * STEP)
        for name, model, k, value in windows
    ]


def test_plain_walk_by_hand():
    at = [START + k * STEP for k in range(12)]
    found = alerts.plain_episodes([(at[0], 5.0), (at[1], 7.0), (at[3], 6.0), (at[6], 9.0)], QUIET, None, at[8])
    # two quiet windows are needed: 1 → 3 goes on, 3 → 6 does not; the last is open while its end is not passed
    assert found == [(at[0], at[5], 3, 5.0, 7.0), (at[6], None, 1, 9.0, 9.0)]
    assert alerts.plain_episodes([(at[6], 9.0)], QUIET, None, at[9])[0][1] == at[8]
    short = alerts.plain_episodes([(t, 1.0) for t in at[:6]], QUIET, timedelta(minutes=45), at[11])
    assert [e[:3] for e in short] == [(at[0], at[3], 3), (at[3], at[6], 3)]


def test_table_equals_plain_walk(spark):
    rng = random.Random(8)
    windows = [(a, m, k, float(rng.randrange(90))) for a, *_ in RULES for m in ("x", "y", None) for k in range(60) if rng.random() < 0.4]
    rows = crossed(windows)
    until = START + 61 * STEP
    got = alerts.episodes(spark.createDataFrame(rows, CROSSED), until=until).collect()
    for name, _, sign, _, _ in RULES:
        for model in ("x", "y", None):
            mine = [(r[8], r[6]) for r in rows if r[0] == name and r[7] == model]
            want = alerts.plain_episodes(mine, QUIET, None, until, sign)
            have = [
                (r["triggered_at"], r["resolved_at"], r["windows"], r["metric_value"], r["peak_value"])
                for r in got if r["alert_name"] == name and r["model"] == model
            ]
            assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["is_active"] != r["is_resolved"] for r in got)
    assert all(r["resolved_at"] is None or r["resolved_at"] >= r["triggered_at"] for r in got)
    assert alerts.episodes(spark.createDataFrame([], CROSSED)).collect() == []


@pytest.mark.parametrize("longest", [None, timedelta(minutes=45)])
def test_stream_equals_plain_walk_however_it_is_cut(spark, make_calls, tmp_path, longest):
    rng = random.Random(3)
    calls = []
    for k in range(400):
        calls.append({
            "timestamp": START + timedelta(minutes=3 * k + (600 if k > 200 else 0)), "model": rng.choice(["a", "b"]),
            "latency_ms": 50.0 + 100 * (k // 25 % 2) * rng.random(),
        })
    landing, root = str(tmp_path / "in"), str(tmp_path / "q")
    for part in range(4):  # four files, in order of time
        rows = make_calls(calls[part * 100 : part * 100 + 100])
        rows.coalesce(1).write.mode("append").json(landing)
        stream = jobs.read_landing(spark, landing)
        with jobs.with_timers(spark):
            lived = jobs.alert_lifecycle(jobs.crossings(stream, RULES), QUIET, longest)
            jobs.run_available(lived, f"{root}/out", f"{root}/cp")
    events = spark.read.schema(alerts.EVENTS).parquet(f"{root}/out")
    table = alerts.standing(events).collect()
    until = max(c["timestamp"] for c in calls) - timedelta(hours=1)

    windows = {}
    for c in calls:
        first = START + (c["timestamp"] - START) // STEP * STEP
        for k in range(4):
            windows.setdefault((c["model"], first - k * STEP + timedelta(hours=1)), []).append(c["latency_ms"])
    want = []
    for name, metric, sign, limit, _ in RULES:
        for model in ("a", "b"):
            values = [
                (end, round(sum(v) / len(v), 2) if metric == "latency_ms" else float(len(v)))
                for (m, end), v in windows.items() if m == model and end <= until
            ]
            over = [(e, v) for e, v in values if (v > limit if sign == ">" else v <= limit)]
            want += [(name, model, *e) for e in alerts.plain_episodes(over, QUIET, longest, until, sign)]
    assert len(want) > 5
    got = [
        (r["alert_name"], r["model"], r["triggered_at"], r["resolved_at"], r["windows"], r["metric_value"], r["peak_value"])
        for r in table
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    # running again adds nothing
    before = events.count()
    with jobs.with_timers(spark):
        jobs.run_available(jobs.alert_lifecycle(jobs.crossings(jobs.read_landing(spark, landing), RULES), QUIET, longest), f"{root}/out", f"{root}/cp")
    assert spark.read.schema(alerts.EVENTS).parquet(f"{root}/out").count() == before
    opened = events.where("event = 'opened'")
    assert opened.count() == opened.select("alert_name", "model", "triggered_at").distinct().count() == len(want)
