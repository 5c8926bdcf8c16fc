"""The mergeable view against the calls it was made from."""

import random
from datetime import timedelta

import pytest

from calltally.operators import metrics, sketches
from tests.conftest import NOW


@pytest.fixture(scope="module")
def calls(make_calls):
    rng = random.Random(2)
    return make_calls([
        {
            "timestamp": NOW - timedelta(hours=rng.randrange(240)), "model": rng.choice(["m1", "m2"]),
            "latency_ms": rng.lognormvariate(5, 1), "cost_usd": rng.randrange(1000) / 1000,
            "user_id": rng.choice([None, *(f"u{k}" for k in range(400))]), "tokens_out": rng.randrange(3),
            "source": rng.choice(["lmsys", "other"]),
        }
        for _ in range(6000)
    ])


@pytest.fixture(scope="module")
def view(spark, calls, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("view") / "v")
    sketches.refresh(calls.where("id % 5 > 0 OR to_date(timestamp) <> '2024-06-05'"), path)
    sketches.refresh(calls, path, ["2024-06-05"])
    return spark.read.parquet(path)


@pytest.mark.parametrize("scope", [{}, {"start": "2024-06-04", "end": "2024-06-09 00:00:00"}, {"start": "2031-01-01"}])
def test_summary_and_percentiles(calls, view, scope):
    upto = scope | ({"end": "2024-06-08 23:59:59"} if "end" in scope else {})  # that period includes its end
    exact, found = metrics.summary(calls, **upto).first(), sketches.summary(view, **scope).first()
    for name in ("total_requests", "total_cost_usd", "avg_latency_ms", "total_tokens", "success_rate_percent"):
        assert found[name] == exact[name]
    assert abs(found["users_estimate"] - exact["unique_users"]) <= max(1, sketches.USERS_ERROR * exact["unique_users"])
    want, got = metrics.percentiles(calls, **upto).first(), sketches.percentiles(view, **scope).first()
    assert got["max"] == pytest.approx(want["max"], abs=0.01) and got["min"] == pytest.approx(want["min"], abs=0.01)
    held = sorted(r["latency_ms"] for r in metrics.scoped(calls, upto.get("start"), upto.get("end"), "lmsys").collect())
    for name, q in sketches.QUANTILES.items():
        if held:
            rank = sum(x <= got[name] for x in held) / len(held)
            assert abs(rank - q) <= sketches.RANK_ERROR + 1 / len(held)
        else:
            assert got[name] == 0.0


def test_view_is_small_and_days_are_pruned(calls, view):
    assert view.count() == calls.selectExpr("to_date(timestamp) AS d", "source", "model").distinct().count()
    plan = sketches.scoped(view, "2024-06-04", "2024-06-05")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-06-04" in plan
    with pytest.raises(ValueError, match="whole days"):
        sketches.summary(view, "2024-06-04 12:30:00")
    assert sketches.by_model(view, source="nobody").collect() == []
