import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from calltally.operators import filters, metrics
from calltally.operators.quantiles import (
    approximate_quantiles,
    grouped_with_quantiles,
    ranked_quantiles,
)
from tests.conftest import NOW, dicts


def test_by_model_goldens(fixture_calls):
    gpt, mistral = dicts(metrics.by_model(fixture_calls))
    assert (gpt["model"], gpt["request_count"], gpt["avg_latency_ms"]) == ("gpt-4", 5, 408.0)
    assert (gpt["p50_latency_ms"], gpt["p95_latency_ms"], gpt["p99_latency_ms"]) == (360, 768, 825.6)
    assert gpt["total_cost_usd"] == 0.1 and gpt["success_rate_percent"] == 100.0
    assert (mistral["request_count"], mistral["p95_latency_ms"], mistral["p99_latency_ms"]) == (3, 610, 642)
    assert mistral["total_cost_usd"] == 0.02


def test_by_hour_goldens(fixture_calls):
    first, second, third = dicts(metrics.by_hour(fixture_calls))
    assert first["hour"] == NOW
    assert (first["requests"], first["avg_latency_ms"], first["p50"], first["p95"], first["p99"]) == (
        3, 210.0, 150, 339, 355.8,
    )
    assert first["avg_cost_usd"] == 0.012667
    assert (second["p50"], second["p95"], second["p99"], second["avg_cost_usd"]) == (250, 457, 475.4, 0.014667)
    assert (third["requests"], third["p50"], third["p95"], third["p99"], third["avg_cost_usd"]) == (
        2, 745, 830.5, 838.1, 0.019,
    )


def test_percentiles_goldens(fixture_calls):
    (row,) = dicts(metrics.percentiles(fixture_calls))
    assert row == {"p50": 305, "p75": 522.5, "p90": 707, "p95": 773.5, "p99": 826.7, "min": 120, "max": 840}


def test_spread_goldens(make_calls, spark):
    calls = make_calls([{"latency_ms": x} for x in (2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0, None)])
    (row,) = dicts(metrics.percentiles_with_spread(calls))
    assert (row["mean"], row["stddev"], row["p50"]) == (5.0, 2.14, 4.5)
    (row,) = dicts(metrics.describe(calls, "latency_ms"))
    assert (row["count"], row["mean"], row["std"], row["q25"], row["q75"]) == (8, 5.0, 2.1381, 4.0, 5.5)


def test_percentiles_of_one_to_hundred(make_calls):
    calls = make_calls([{"latency_ms": float(i)} for i in range(1, 101)])
    (row,) = dicts(metrics.percentiles(calls))
    assert (row["p50"], row["p75"], row["p90"], row["p95"], row["p99"]) == (50.5, 75.25, 90.1, 95.05, 99.01)


def test_period_is_inclusive_on_both_sides(fixture_calls):
    inside = filters.in_period(fixture_calls, NOW, NOW + timedelta(minutes=59))
    assert inside.count() == 3
    assert filters.in_period(fixture_calls, NOW, NOW + timedelta(hours=1)).count() == 6
    assert filters.in_period(fixture_calls, "2024-06-11T14:00:00Z").count() == 2


def test_malformed_period_is_an_error(fixture_calls):
    with pytest.raises(Exception, match="not an ISO-8601 time"):
        filters.in_period(fixture_calls, "yesterday").collect()


def test_empty_scope_defaults(fixture_calls):
    far = NOW + timedelta(days=999)
    (row,) = dicts(metrics.summary(fixture_calls, far))
    assert row["total_requests"] == 0 and row["success_rate_percent"] == 100.0
    assert row["total_cost_usd"] == 0.0 and row["models"] == ""
    (row,) = dicts(metrics.percentiles(fixture_calls, far))
    assert set(row.values()) == {0.0}
    assert metrics.by_model(fixture_calls, far).count() == 0


def test_empty_model_name_is_no_filter(fixture_calls):
    assert dicts(metrics.percentiles(fixture_calls, model="")) == dicts(metrics.percentiles(fixture_calls))


def test_summary_counts_users_models_and_success(make_calls):
    calls = make_calls(
        [
            {"user_id": "a", "tokens_out": 0}, {"user_id": "a", "model": "palm-2"}, {"user_id": "b"},
            {"user_id": None, "model": ""}, {"source": "upload_x", "user_id": "z"},
        ]
    )
    (row,) = dicts(metrics.summary(calls))
    assert (row["total_requests"], row["unique_users"], row["models"]) == (4, 2, "gpt-4,palm-2")
    assert row["success_rate_percent"] == 75.0


def test_cost_breakdown_covers_all_sources_but_hours_only_one(make_calls):
    calls = make_calls(
        [{"cost_usd": 0.01}] * 5
        + [{"cost_usd": 0.005, "model": "claude-3-opus", "source": "upload_x"}] * 5
    )
    rows = {(r["scope"], r["key"]): r["cost"] for r in dicts(metrics.cost_breakdown(calls))}
    assert rows[("total", "")] == 0.075
    assert rows[("model", "gpt-4")] == 0.05 and rows[("model", "claude-3-opus")] == 0.025
    assert rows[("hour", "2024-06-11T12:00:00")] == 0.05


def test_hourly_cost_keeps_the_rounded_mean(make_calls):
    calls = make_calls([{"cost_usd": 0.0000005}, {"cost_usd": 0.0000001}, {"cost_usd": 0.0000001}])
    (row,) = [r for r in dicts(metrics.cost_breakdown(calls)) if r["scope"] == "hour"]
    assert row["cost"] == 0.0 and row["exact_cost"] == 0.000001


def test_sources_add_up(make_calls):
    calls = make_calls([{"source": s, "model": m} for s in ("lmsys", "x") for m in ("a", "b", "b")])
    rows = dicts(metrics.all_sources(calls))
    totals = {r["source"]: r for r in rows if r["is_source_row"]}
    assert totals["x"]["total_requests"] == 3 and totals["x"]["model_count"] == 2
    assert sum(r["total_requests"] for r in rows if not r["is_source_row"]) == 6
    (unknown,) = dicts(metrics.by_source(calls, "nobody"))
    assert unknown["total_requests"] == 0 and unknown["success_rate_percent"] == 100.0
    assert unknown["model_count"] == 0


def test_by_model_sums_to_the_summary(fixture_calls):
    (total,) = dicts(metrics.summary(fixture_calls))
    assert sum(r["request_count"] for r in dicts(metrics.by_model(fixture_calls))) == total["total_requests"]


def built_in(df, shares):
    """Spark's own exact form, which holds a group's values in one task."""
    listed = ", ".join(f"{x}D" for x in shares.values())
    return {
        r["key"]: dict(zip(shares, r["q"] or [None] * len(shares), strict=True))
        for r in df.groupBy("key").agg(F.expr(f"percentile(value, array({listed}))").alias("q")).collect()
    }


def same(want, got):
    if want is None or got is None:
        return want is got
    return math.isnan(want) and math.isnan(got) or want == got or abs(want - got) < 1e-9


def test_quantiles_equal_the_built_in_form(spark):
    rng = random.Random(5)
    rows = []
    for key in ("a", "b", None, "hot"):
        for _ in range(2000 if key == "hot" else rng.choice([1, 2, 37])):
            rows.append((key, rng.choice([0.0, -1.5, 3.25, 3.25, rng.uniform(-50, 5000), rng.lognormvariate(3, 2)])))
    rows.append(("nothing", None))
    nan, inf = float("nan"), float("inf")
    rows += [("nan", x) for x in (1.0, 2.0, 3.0, nan, 1000.0, 2000.0, 3000.0)] + [("inf", x) for x in (1.0, 2.0, 3.0, inf)]
    rows += [("ends", x) for x in (-inf, -inf, -1e308, 0.0, 1e308, inf, nan, nan)]
    df = spark.createDataFrame(rows, "key string, value double")
    shares = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    want = built_in(df, shares)
    got = {r["key"]: r for r in grouped_with_quantiles(df, ["key"], [("n", F.count("*"), "sum")], "value", shares).collect()}
    assert want.keys() == got.keys()
    for key, row in want.items():
        assert got[key]["n"] == sum(k == key for k, _ in rows)
        for name in shares:
            assert same(row[name], got[key][name]), (key, name, row[name], got[key][name])


def test_quantiles_scan_their_input_twice(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS key", "id * 1.5 AS value").write.parquet(str(tmp_path / "t"))
    grouped = grouped_with_quantiles(
        spark.read.parquet(str(tmp_path / "t")), ["key"], [("n", F.count("*"), "sum")], "value", {"m": 0.5}
    )
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1  # the second; the first has been folded


@pytest.mark.parametrize("heavy,broadcast", [(3, 1 << 20), (3, 0), (10**9, 0), (10**9, 1 << 20)])
def test_heavy_buckets_are_divided(spark, heavy, broadcast):
    """Values crowded into one narrow bucket, a heavy single value, and many groups."""
    rows = [("crowd", 1000.0 + i * 1e-9) for i in range(400)] + [("same", 7.0)] * 50
    rows += [(f"g{i % 30}", float(i * i % 977)) for i in range(600)]
    rows += [("wide", x) for x in (-1e300, -5e-324, 0.0, 5e-324, 1e300)]
    df = spark.createDataFrame(rows, "key string, value double")
    shares = {"q0": 0.0, "q30": 0.3, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    want = built_in(df, shares)
    got = {r["key"]: r for r in ranked_quantiles(df, ["key"], "value", shares, heavy, broadcast).collect()}
    assert want.keys() == got.keys()
    for key in want:
        assert [got[key][n] for n in shares] == [want[key][n] for n in shares], key


def test_ranked_quantiles_with_two_keys_and_narrow_values(spark):
    rows = [(i % 3, "x", 1e9 + i * 1e-6) for i in range(999)]
    df = spark.createDataFrame(rows, "a int, b string, value double")
    got = {r["a"]: r["m"] for r in ranked_quantiles(df, ["a", "b"], "value", {"m": 0.5}).collect()}
    assert got[0] == pytest.approx(1e9 + 498e-6, abs=1e-9)


def test_approximate_quantiles_keep_their_rank_error(spark):
    df = spark.range(200_000).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("value"))
    (row,) = approximate_quantiles(df, ["key"], "value", {"p50": 0.5, "p99": 0.99}, 1000).collect()
    assert abs(row["p50"] - 100_000) <= 200 and abs(row["p99"] - 198_000) <= 200


def test_paging(make_calls):
    calls = make_calls([{"timestamp": NOW + timedelta(minutes=i)} for i in range(25)])
    first = [r["id"] for r in filters.newest_first(calls, 1, 10).collect()]
    assert first == list(range(25, 15, -1))
    assert [r["id"] for r in filters.newest_first(calls, 3, 10).collect()] == [5, 4, 3, 2, 1]
    assert filters.newest_first(calls, 4, 10).count() == 0
    after = filters.next_page(calls, NOW + timedelta(minutes=15), 16, 10)
    assert [r["id"] for r in after.collect()] == list(range(15, 5, -1))
    assert dicts(filters.page_count(calls, 10)) == [{"total": 25, "pages": 3}]
    assert dicts(filters.page_count(calls.limit(0), 10)) == [{"total": 0, "pages": 1}]
    with pytest.raises(ValueError):
        filters.newest_first(calls, 1, 201)


@pytest.mark.parametrize("share,want", [(0.1, 1000), (0.00001, 1), (0.5, 5000), (1.0, 10000)])
def test_sample_has_the_exact_size_and_is_repeatable(spark, share, want):
    ids = spark.range(10_000)
    one = {r["id"] for r in filters.sample_rows(ids, share, "s").collect()}
    two = {r["id"] for r in filters.sample_rows(ids.repartition(7), share, "s").collect()}
    assert len(one) == want and one == two
    if share == 0.5:
        assert one != {r["id"] for r in filters.sample_rows(ids, share, "t").collect()}


def test_long_texts_are_cut(make_calls):
    row = dicts(filters.log_rows(make_calls([{"prompt": "x" * 121, "response": "y" * 120}])))[0]
    assert row["prompt"] == "x" * 120 + "…" and row["response"] == "y" * 120


def test_cost_share_adds_to_hundred(fixture_calls):
    rows = dicts(metrics.cost_share(fixture_calls, "model"))
    assert {r["model"]: r["percent"] for r in rows} == {"gpt-4": 83.3, "mistral-large": 16.7}
    free = metrics.cost_share(fixture_calls.withColumn("cost_usd", F.lit(0.0)), "model")
    assert {r["percent"] for r in dicts(free)} == {0.0}
