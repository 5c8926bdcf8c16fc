"""A query of every kind next to its SQL twin on the smallest driver tables.

`check.py` runs all of them; this keeps the suite short.
"""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import _rows

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "ag01_summary", "ag02_by_model", "ag03_by_hour_ranked", "ag06_cost_breakdown", "ag07_all_sources",
    "ag09_eval_summary", "ag10x_score_cube", "ag11_model_daily_performance", "ag16_load_report",
    "ag22_cost_share_by_user", "ag28_threshold_alerts", "ag29_anomaly_alerts", "ag30_child_counts",
    "dq3_accepted_rows", "dq6_battle_audit", "cl3_cl4_filled_cells", "cl18_flat_messages",
    "etl1_etl2_battle_sides", "etl4_upload_scores_unstemmed", "src1_upload_csv", "src4_replayed_calls",
    "snk6_without_dataset", "s3_newest_page", "s6_sample", "txt5_jaccard", "txt6_cosine", "txt7_rules",
    "txt8_judge_requests", "st2_hourly_rollup", "st4_alert_lifecycle", "st5_user_sessions",
    "ag28_alert_episodes", "ag30_trace_trees", "snk8_sketch_by_model", "snk8_sketch_percentiles",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    cursor = duck.execute(oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    assert _rows(result.columns, [tuple(r) for r in result.collect()]) == _rows(names, cursor.fetchall())


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() == 5
