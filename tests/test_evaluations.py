from datetime import timedelta

import pytest

from calltally.operators import evaluations
from tests.conftest import NOW, dicts


@pytest.fixture(scope="module")
def arena(make_calls, make_evals):
    """Five battles, two completions each, and two benchmark rows."""
    battles = [
        ("gpt-4", "palm-2", "model_a"), ("gpt-4", "palm-2", "model_b"), ("palm-2", "gpt-4", "model_b"),
        ("mistral-large", "gpt-4", "tie"), ("mistral-large", "palm-2", "model_a"),
    ]
    calls, scores = [], []
    for a, b, winner in battles:
        for side, model, share in (("model_a", a, 1.0), ("model_b", b, 0.75)):
            calls.append({"model": model, "latency_ms": 400 * share, "cost_usd": 0.007})
            score = 0.5 if winner == "tie" else float(winner == side)
            scores.append((len(calls), "human_preference", score))
    for bleu, rouge, human in ((0.25, 0.35, 0.9), (0.15, 0.25, 0.5)):
        calls.append(
            {"model": "eval-dataset", "latency_ms": 0.0, "cost_usd": 0.0, "source": "evals_benchmark"}
        )
        scores += [(len(calls), "bleu", bleu), (len(calls), "rouge", rouge), (len(calls), "human", human)]
    return make_evals(scores), make_calls(calls)


def test_model_comparison(arena):
    rows = dicts(evaluations.model_comparison(*arena))
    assert [r["model"] for r in rows] == ["mistral-large", "gpt-4", "palm-2"]
    mistral, gpt, palm = rows
    assert (gpt["battles"], gpt["wins"], gpt["ties"], gpt["losses"]) == (4, 2, 1, 1)
    assert (gpt["win_rate"], gpt["win_tie_rate"], gpt["win_tie_rate_pct"]) == (0.5, 0.625, 62.5)
    assert (mistral["win_rate"], mistral["win_tie_rate"]) == (0.5, 0.75)
    assert (palm["win_rate"], palm["win_tie_rate"], palm["avg_latency_ms"]) == (0.25, 0.25, 325.0)
    assert all(r["wins"] + r["ties"] + r["losses"] == r["battles"] for r in rows)
    assert dicts(evaluations.total_battles(evaluations.model_comparison(*arena))) == [{"total_battles": 10}]


def test_other_scores_count_as_battles_only(make_calls, make_evals):
    calls = make_calls([{}, {}])
    scores = make_evals([(1, "human_preference", 1.0), (2, "human_preference", 0.7)])
    (row,) = dicts(evaluations.model_comparison(scores, calls))
    assert (row["battles"], row["wins"], row["ties"], row["losses"]) == (2, 1, 0, 0)


def test_eval_summary_filters_only_the_arena_figures(arena):
    far = NOW + timedelta(days=99)
    rows = {(r["source"], r["eval_type"], r["metric"]): r["value"] for r in dicts(evaluations.eval_summary(*arena, start=far))}
    assert rows[("lmsys", "", "completions")] == 0
    assert rows[("lmsys", "human_preference", "count")] == 10
    assert rows[("evals_benchmark", "", "completions")] == 2
    assert rows[("evals_benchmark", "bleu", "avg")] == 0.2
    assert (rows[("evals_benchmark", "bleu", "min")], rows[("evals_benchmark", "bleu", "max")]) == (0.15, 0.25)
    assert rows[("evals_benchmark", "human", "avg")] == 0.7


def test_histogram_edges_and_empty_buckets(make_calls, make_evals):
    scores = make_evals([(1, "human", s) for s in (0.0, 0.2, 0.39, 0.8, 1.0)])
    rows = {r["range"]: r["count"] for r in dicts(evaluations.score_histogram(scores, make_calls([{}])))}
    assert rows == {"0–20%": 1, "20–40%": 2, "40–60%": 0, "60–80%": 0, "80–100%": 2}


def test_overall_is_null_without_scores(make_calls, make_evals):
    nothing = make_evals([(99, "human", 0.5)])
    assert dicts(evaluations.score_overall(nothing, make_calls([{}]))) == [
        {"overall_avg_score": None, "total_evals": 0}
    ]


def test_pivot_leaves_missing_types_null(arena):
    rows = {r["model"]: r for r in dicts(evaluations.model_type_scores(*arena))}
    assert rows["eval-dataset"]["bleu"] == 0.2 and rows["eval-dataset"]["human_preference"] is None
    assert rows["gpt-4"]["bleu"] is None and rows["gpt-4"]["human_preference"] == 0.625


def test_cube_agrees_with_its_single_queries(arena):
    cube = dicts(evaluations.score_cube(*arena))
    per_type = {r["eval_type"]: r["avg_score"] for r in cube if r["level"] == 6}
    assert per_type == {r["eval_type"]: r["avg_score"] for r in dicts(evaluations.scores_by_type(*arena))}
    (overall,) = [r for r in cube if r["level"] == 7]
    (single,) = dicts(evaluations.score_overall(*arena))
    assert overall["avg_score"] == single["overall_avg_score"]
    assert overall["count"] == single["total_evals"]


def test_win_rates_cover_every_source(make_calls, make_evals):
    calls = make_calls([{"source": "upload_x", "model": "m"}])
    rows = dicts(evaluations.win_rates(make_evals([(1, "human_preference", 1.0)]), calls))
    assert rows[0]["win_rate"] == 1.0
    assert dicts(evaluations.model_comparison(make_evals([(1, "human_preference", 1.0)]), calls)) == []


def test_rating_distribution(spark):
    rows = spark.createDataFrame([(r,) for r in (1, 3, 4, 7, 8, 10, 10)], "rating int")
    got = {(r["scope"], r["key"]): r["count"] for r in dicts(evaluations.rating_distribution(rows, "rating"))}
    assert got[("rating", "10")] == 2
    assert (got[("tier", "excellent")], got[("tier", "mediocre")], got[("tier", "poor")]) == (3, 2, 2)


def test_outcome_shares_and_quality(arena):
    comparison = evaluations.model_comparison(*arena)
    shares = {r["model"]: r for r in dicts(evaluations.outcome_shares(comparison))}
    assert (shares["gpt-4"]["win_pct"], shares["gpt-4"]["tie_pct"], shares["gpt-4"]["loss_pct"]) == (50, 25, 25)
    quality = {r["model"]: r["quality_score"] for r in dicts(evaluations.quality_scores(comparison))}
    assert quality["mistral-large"] == 7.5
    assert [r["model"] for r in evaluations.best_models(comparison, 2).collect()] == ["mistral-large", "gpt-4"]
