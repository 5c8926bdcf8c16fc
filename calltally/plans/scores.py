"""Queries over scores joined to completions, and over datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers
from calltally.operators import etl, evaluations, filters, judge, metrics, quality
from calltally.operators import batch as batches
from calltally.plans.inputs import completions, evals, pairs, table, uploads
from calltally.plans.registry import query
from calltally.plans.traffic import END, PERIOD, START
from calltally.plans.twins import (
    OK,
    PAIRS_CTE,
    UPLOADS_CTE,
    mean,
    over,
    over_completions,
    over_evals,
    over_scored,
    percent,
    usd,
    usd_mean,
    usd_total,
)

HP = "eval_type = 'human_preference'"
OUTCOMES = """count(*) AS battles, count(*) FILTER (WHERE score = 1.0) AS wins,
  count(*) FILTER (WHERE score = 0.5) AS ties, count(*) FILTER (WHERE score = 0.0) AS losses"""
RATES = """round(wins / battles, 4) AS win_rate,
  round((wins + ties * 0.5::DOUBLE) / battles, 4) AS win_tie_rate"""


def comparison_cte(where: str) -> str:
    return f"""counted AS (SELECT model, {OUTCOMES}, {mean('latency_ms', 2)} AS avg_latency_ms,
    {usd_mean('cost_usd')} AS avg_cost_usd
  FROM scored WHERE {where} GROUP BY model),
rated AS (SELECT *, {RATES} FROM counted),
comparison AS (SELECT *, round(win_rate * 100, 1) AS win_rate_pct,
    round(win_tie_rate * 100, 1) AS win_tie_rate_pct FROM rated)"""


COMPARISON = comparison_cte(f"{HP} AND source = 'lmsys'")
COMPARISON_COLUMNS = (
    "model, battles, wins, ties, losses, win_rate, win_rate_pct, win_tie_rate, win_tie_rate_pct,"
    " avg_latency_ms, avg_cost_usd"
)


def _comparison(spark, folder):
    return evaluations.model_comparison(evals(spark, folder), completions(spark, folder))


@query("ag08_model_comparison", over_scored(f"SELECT {COMPARISON_COLUMNS} FROM comparison", COMPARISON))
def _(spark, folder):
    return _comparison(spark, folder)


@query(
    "ag08_model_comparison_in_period",
    over_scored(
        f"SELECT {COMPARISON_COLUMNS} FROM comparison",
        comparison_cte(f"{HP} AND source = 'lmsys' AND {PERIOD}"),
    ),
)
def _(spark, folder):
    return evaluations.model_comparison(
        evals(spark, folder), completions(spark, folder), START, END
    )


@query(
    "ag08_total_battles",
    over_scored("SELECT CAST(sum(battles) AS BIGINT) AS total_battles FROM comparison", COMPARISON),
)
def _(spark, folder):
    return evaluations.total_battles(_comparison(spark, folder))


SUMMARY_PARTS = f"""lines AS (
  SELECT count(*) AS n, count(DISTINCT model) AS models, {mean('latency_ms', 2)} AS latency,
    {usd(usd_total('cost_usd'), 4)} AS cost
  FROM completions WHERE source = 'lmsys' AND {PERIOD}),
bench AS (SELECT eval_type, count(*) AS n, {mean('score', 4)} AS a,
    round(min(score), 4) AS lo, round(max(score), 4) AS hi
  FROM scored WHERE source = 'evals_benchmark' GROUP BY eval_type)"""

SUMMARY_SQL = """SELECT 'lmsys' AS source, '' AS eval_type, 'completions' AS metric,
  CAST(n AS DOUBLE) AS value FROM lines
UNION ALL SELECT 'lmsys', '', 'models', CAST(models AS DOUBLE) FROM lines
UNION ALL SELECT 'lmsys', '', 'avg_latency_ms', latency FROM lines
UNION ALL SELECT 'lmsys', '', 'total_cost_usd', cost FROM lines
UNION ALL SELECT 'lmsys', eval_type, 'count', CAST(count(*) AS DOUBLE) FROM scored
  WHERE source = 'lmsys' AND eval_type = 'human_preference' GROUP BY eval_type
UNION ALL SELECT 'evals_benchmark', '', 'completions', CAST(count(*) AS DOUBLE)
  FROM completions WHERE source = 'evals_benchmark'
UNION ALL SELECT 'evals_benchmark', eval_type, 'count', CAST(n AS DOUBLE) FROM bench
UNION ALL SELECT 'evals_benchmark', eval_type, 'avg', a FROM bench
UNION ALL SELECT 'evals_benchmark', eval_type, 'min', lo FROM bench
UNION ALL SELECT 'evals_benchmark', eval_type, 'max', hi FROM bench"""


@query("ag09_eval_summary", over_scored(SUMMARY_SQL, SUMMARY_PARTS))
def _(spark, folder):
    return evaluations.eval_summary(evals(spark, folder), completions(spark, folder), START, END)


STATS = f"""count(*) AS count, {mean('score', 4)} AS avg_score,
  round(coalesce(min(score), 0), 4) AS min_score, round(coalesce(max(score), 0), 4) AS max_score"""


@query("ag10a_scores_by_type", over_scored(f"SELECT eval_type, {STATS} FROM scored GROUP BY eval_type"))
def _(spark, folder):
    return evaluations.scores_by_type(evals(spark, folder), completions(spark, folder))


@query(
    "ag10b_histogram",
    over_scored(
        """SELECT '0–20%' AS range, count(*) FILTER (WHERE score < 0.2) AS count FROM scored
UNION ALL SELECT '20–40%', count(*) FILTER (WHERE score >= 0.2 AND score < 0.4) FROM scored
UNION ALL SELECT '40–60%', count(*) FILTER (WHERE score >= 0.4 AND score < 0.6) FROM scored
UNION ALL SELECT '60–80%', count(*) FILTER (WHERE score >= 0.6 AND score < 0.8) FROM scored
UNION ALL SELECT '80–100%', count(*) FILTER (WHERE score >= 0.8) FROM scored"""
    ),
)
def _(spark, folder):
    return evaluations.score_histogram(evals(spark, folder), completions(spark, folder))


@query(
    "ag10c_trend",
    over_scored(
        f"""SELECT date_trunc('hour', timestamp) AS hour, {mean('score', 4)} AS avg_score,
  count(*) AS count FROM scored GROUP BY 1"""
    ),
)
def _(spark, folder):
    return evaluations.score_trend(evals(spark, folder), completions(spark, folder))


PIVOT = ", ".join(
    f"round(avg(score) FILTER (WHERE eval_type = '{name}'), 4) AS {name}" for name in values.EVAL_TYPES
)


@query("ag10d_model_type_pivot", over_scored(f"SELECT model, {PIVOT} FROM scored GROUP BY model"))
def _(spark, folder):
    return evaluations.model_type_scores(evals(spark, folder), completions(spark, folder))


@query(
    "ag10e_hour_type_pivot",
    over_scored(f"SELECT date_trunc('hour', timestamp) AS hour, {PIVOT} FROM scored GROUP BY 1"),
)
def _(spark, folder):
    return evaluations.hour_type_scores(evals(spark, folder), completions(spark, folder))


@query(
    "ag10f_overall",
    over_scored(
        "SELECT round(avg(score), 4) AS overall_avg_score, count(score) AS total_evals FROM scored"
    ),
)
def _(spark, folder):
    return evaluations.score_overall(evals(spark, folder), completions(spark, folder))


@query(
    "ag10g_win_rates",
    over_scored(
        f"SELECT model, battles, wins, ties, losses, {RATES} FROM counted",
        f"counted AS (SELECT model, {OUTCOMES} FROM scored WHERE {HP} GROUP BY model)",
    ),
)
def _(spark, folder):
    return evaluations.win_rates(evals(spark, folder), completions(spark, folder))


@query(
    "ag10x_score_cube",
    over_scored(
        f"""SELECT CAST(grouping(hour) * 4 + grouping(model) * 2 + grouping(eval_type) AS BIGINT) AS level,
  hour, model, eval_type, {STATS}
FROM (SELECT *, date_trunc('hour', timestamp) AS hour FROM scored)
GROUP BY GROUPING SETS ((), (eval_type), (hour), (model, eval_type), (hour, eval_type))"""
    ),
)
def _(spark, folder):
    return evaluations.score_cube(evals(spark, folder), completions(spark, folder))


@query(
    "ag14_dataset_scores",
    over_scored(
        """SELECT eval_type, round(avg(score), 4) AS avg_score FROM scored
WHERE source = 'upload_a' GROUP BY eval_type"""
    ),
)
def _(spark, folder):
    return evaluations.dataset_scores(evals(spark, folder), completions(spark, folder), "upload_a")


@query(
    "ag14_dataset_models",
    over_completions(
        "SELECT model, count(*) AS count FROM completions WHERE source = 'upload_a' GROUP BY model"
    ),
)
def _(spark, folder):
    return evaluations.dataset_models(completions(spark, folder), "upload_a")


LISTING = over_scored(
    """SELECT u.*, m.eval_type, m.avg_score FROM uploads u LEFT JOIN
  (SELECT source, eval_type, round(avg(score), 4) AS avg_score FROM scored GROUP BY 1, 2) m
  ON m.source = u.source_id""",
    UPLOADS_CTE,
)


@query("ag15_dataset_listing", LISTING)
def _(spark, folder):
    return evaluations.dataset_listing(
        uploads(spark, folder), evals(spark, folder), completions(spark, folder)
    )


@query(
    "ag16_load_report",
    over_evals(
        """SELECT 'completions' AS scope, '' AS key, count(*) AS count, CAST(NULL AS DOUBLE) AS avg_score
  FROM completions
UNION ALL SELECT 'source', source, count(*), NULL FROM completions GROUP BY source
UNION ALL SELECT 'evals', '', count(*), NULL FROM evals
UNION ALL SELECT 'eval_type', eval_type, count(*), round(avg(score), 3) FROM evals GROUP BY eval_type"""
    ),
)
def _(spark, folder):
    return evaluations.load_report(evals(spark, folder), completions(spark, folder))


@query(
    "ag17_rating_distribution",
    """WITH rated AS (SELECT CAST(event_id * 7 % 10 + 1 AS INT) AS rating FROM events)
SELECT 'rating' AS scope, CAST(rating AS VARCHAR) AS key, count(*) AS count FROM rated GROUP BY rating
UNION ALL SELECT 'tier', CASE WHEN rating >= 8 THEN 'excellent' WHEN rating >= 4 THEN 'mediocre'
  ELSE 'poor' END, count(*) FROM rated GROUP BY 2""",
)
def _(spark, folder):
    rated = table(spark, folder, "events").select((F.col("event_id") * 7 % 10 + 1).alias("rating"))
    return evaluations.rating_distribution(rated, "rating")


def _share(column: str) -> str:
    return f"round({column} / battles * 100, 1)"


@query(
    "ag25_outcome_shares",
    over_scored(
        f"""SELECT model, battles, win_rate_pct, win_tie_rate_pct, {_share('wins')} AS win_pct,
  {_share('ties')} AS tie_pct, {_share('losses')} AS loss_pct FROM comparison""",
        COMPARISON,
    ),
)
def _(spark, folder):
    return evaluations.outcome_shares(_comparison(spark, folder))


@query(
    "ag26_quality_scores",
    over_scored(
        "SELECT model, round(win_tie_rate_pct / 10, 1) AS quality_score FROM comparison", COMPARISON
    ),
)
def _(spark, folder):
    return evaluations.quality_scores(_comparison(spark, folder))


@query(
    "s4_best_models",
    over_scored(
        f"SELECT {COMPARISON_COLUMNS} FROM comparison ORDER BY win_tie_rate DESC, model LIMIT 2",
        COMPARISON,
    ),
)
def _(spark, folder):
    return evaluations.best_models(_comparison(spark, folder), 2)


@query(
    "p6_score_bands",
    over_evals(
        """SELECT eval_type, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium'
  ELSE 'low' END AS band, count(*) AS count FROM evals GROUP BY 1, 2"""
    ),
)
def _(spark, folder):
    return evaluations.score_bands(evals(spark, folder))


@query(
    "f9_eval_listing",
    over_evals(
        """SELECT id, completion_id, eval_type, score FROM evals
WHERE eval_type = 'llm_judge' AND score >= 0.25 AND score <= 0.9 ORDER BY id LIMIT 100 OFFSET 50"""
    ),
)
def _(spark, folder):
    listed = filters.eval_rows(evals(spark, folder), "llm_judge", 0.25, 0.9, 100, 50)
    return listed.select("id", "completion_id", "eval_type", "score")


@query(
    "j1_scored_calls",
    over_scored("SELECT completion_id, eval_type, score, model, source FROM scored"),
)
def _(spark, folder):
    return evaluations.scored_calls(
        evals(spark, folder), completions(spark, folder), "model", "source"
    )


@query(
    "j3_requested_rows",
    over_completions(
        "SELECT id, model FROM completions WHERE id IN (SELECT event_id * 3 FROM events)"
    ),
)
def _(spark, folder):
    ids = table(spark, folder, "events").select((F.col("event_id") * 3).alias("id"))
    return batches.requested_rows(completions(spark, folder).select("id", "model"), ids)


@query(
    "j4_unjudged",
    over_evals(
        """SELECT id, model FROM completions WHERE source = 'evals_benchmark'
  AND id NOT IN (SELECT completion_id FROM evals WHERE eval_type = 'llm_judge')"""
    ),
)
def _(spark, folder):
    return judge.unjudged(completions(spark, folder), evals(spark, folder)).select("id", "model")


ORPHANS = over_evals(
    """SELECT id, completion_id, eval_type FROM evals
WHERE completion_id NOT IN (SELECT id FROM completions)"""
)


@query("j5_dq5_orphan_evals", ORPHANS)
def _(spark, folder):
    return quality.orphan_evals(evals(spark, folder), completions(spark, folder)).select(
        "id", "completion_id", "eval_type"
    )


@query(
    "j7_dataset_means",
    over_scored(
        """SELECT u.source_id, u.row_count, m.eval_type, m.avg_score FROM uploads u LEFT JOIN
  (SELECT source, eval_type, round(avg(score), 4) AS avg_score FROM scored GROUP BY 1, 2) m
  ON m.source = u.source_id""",
        UPLOADS_CTE,
    ),
)
def _(spark, folder):
    listing = evaluations.dataset_listing(
        uploads(spark, folder), evals(spark, folder), completions(spark, folder)
    )
    return listing.select("source_id", "row_count", "eval_type", "avg_score")


@query(
    "j8_sources_side_by_side",
    over_completions(
        f"""SELECT count(*) FILTER (WHERE source = 'lmsys') AS left_requests,
  count(*) FILTER (WHERE source = 'evals_benchmark') AS right_requests,
  round(avg(latency_ms) FILTER (WHERE source = 'lmsys'), 2) AS left_latency_ms,
  round(avg(latency_ms) FILTER (WHERE source = 'evals_benchmark'), 2) AS right_latency_ms
FROM completions"""
    ),
)
def _(spark, folder):
    return metrics.side_by_side(completions(spark, folder), values.ARENA, values.BENCHMARK)


@query(
    "u2_tagged_union",
    over(
        """SELECT source, count(*) AS rows FROM (
  SELECT 'lmsys' AS source FROM pairs UNION ALL SELECT 'evals_benchmark' FROM benchmark)
GROUP BY source""",
        PAIRS_CTE,
    ),
)
def _(spark, folder):
    both = etl.tagged_union(
        {
            values.ARENA: pairs(spark, folder).select(F.col("prompt").alias("text")),
            values.BENCHMARK: table(spark, folder, "benchmark").select("text"),
        }
    )
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "u3_long_scores",
    over_completions(
        """SELECT id AS completion_id, 'speed' AS eval_type, 1 / (1 + latency_ms) AS score FROM completions
UNION ALL SELECT id, 'answered', CASE WHEN tokens_out > 0 THEN 1.0 ELSE 0.0 END FROM completions"""
    ),
)
def _(spark, folder):
    wide = completions(spark, folder).select(
        "id",
        (1 / (1 + F.col("latency_ms"))).alias("speed"),
        F.when(F.col("tokens_out") > 0, 1.0).otherwise(0.0).alias("answered"),
    )
    return etl.long_scores(wide, "id", ["speed", "answered"])


@query(
    "txt11_batch_progress",
    over_evals(
        """SELECT job_id, count(*) AS total, count(*) FILTER (WHERE scored OR unknown) AS done,
  CASE WHEN bool_and(scored OR unknown) THEN 'complete' ELSE 'processing' END AS status
FROM (SELECT job_id, id IN (SELECT completion_id FROM evals WHERE eval_type = 'llm_judge') AS scored,
    id NOT IN (SELECT id FROM completions) AS unknown
  FROM (SELECT 'job_' || event_type AS job_id, event_id AS id FROM events
    UNION ALL SELECT 'job_unknown', event_id + 20000000000 FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT 'job_judged', completion_id FROM evals WHERE eval_type = 'llm_judge'))
GROUP BY job_id"""
    ),
)
def _(spark, folder):
    requests = table(spark, folder, "events").select(
        F.concat(F.lit("job_"), "event_type").alias("job_id"), F.col("event_id").alias("id")
    )
    judged = evals(spark, folder).where(F.col("eval_type") == "llm_judge")
    unknown = table(spark, folder, "events").where("event_id % 10 = 0").select(
        F.lit("job_unknown").alias("job_id"), (F.col("event_id") + 20_000_000_000).alias("id")
    )
    scored = judged.select(F.lit("job_judged").alias("job_id"), F.col("completion_id").alias("id"))
    requests = requests.unionByName(unknown).unionByName(scored)
    return batches.batch_progress(requests, judged, completions(spark, folder))


@query(
    "s1_s2_ranked_models",
    over_completions(
        f"""SELECT model, count(*) AS requests, {percent(OK, 'count(*)')} AS success_rate_percent
FROM completions GROUP BY model ORDER BY requests DESC, model"""
    ),
)
def _(spark, folder):
    return (
        completions(spark, folder)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            numbers.percent(
                F.count(F.when(F.col("tokens_out") > 0, 1)), F.count(F.lit(1))
            ).alias("success_rate_percent"),
        )
        .orderBy(F.col("requests").desc(), "model")
    )
