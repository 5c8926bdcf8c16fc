from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from calltally import schemas
from calltally.streaming import jobs
from tests.conftest import NOW


@pytest.fixture()
def land(spark, make_calls, tmp_path):
    """Writes calls as JSON lines into a landing folder and opens a stream on it."""
    folder = str(tmp_path / "landing")

    def write(rows, first=0):
        calls = make_calls(rows).withColumn("id", F.col("id") + first)
        calls.coalesce(1).write.mode("append").json(folder)
        return jobs.read_landing(spark, folder)

    return write


def finish(spark, rows, tmp_path, name="q"):
    jobs.run_available(rows, str(tmp_path / name / "out"), str(tmp_path / name / "cp"))
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name / "out"))


def test_ingest_splits_and_repeats_nothing(spark, land, tmp_path):
    paths = str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")
    stream = land([{}, {"tokens_in": 0}, {"cost_usd": 0.0}])
    jobs.ingest(stream, *paths).awaitTermination()
    jobs.ingest(stream, *paths).awaitTermination()
    land([{"latency_ms": -1.0}, {}], first=10)
    jobs.ingest(stream, *paths).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [1, 3, 12]
    assert {r["id"]: r["reasons"] for r in spark.read.parquet(paths[1]).collect()} == {
        2: ["tokens_in must be > 0"], 11: ["latency_ms must be > 0"],
    }


def test_unreadable_line_is_rejected_not_fatal(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1, "prompt": "p"\nnot json\n')
    paths = str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")
    jobs.ingest(jobs.read_landing(spark, str(folder)), *paths).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 2


def test_only_closed_hours_come_out(spark, land, tmp_path):
    rows = [{"timestamp": NOW + timedelta(minutes=m), "latency_ms": float(m + 1)} for m in (0, 10, 59, 70, 185)]
    got = finish(spark, jobs.hourly_rollup(land(rows)), tmp_path).collect()
    assert {(r["hour"], r["requests"]) for r in got} == {(NOW, 3), (NOW + timedelta(hours=1), 1)}
    (first,) = [r for r in got if r["hour"] == NOW]
    assert (first["p50_approx"], first["p95_approx"]) == (11.0, 60.0)


def test_repeats_are_dropped_within_the_watermark(spark, land, tmp_path):
    rows = [{"conversation_id": c} for c in ("a", "b", "a", "a")]
    got = finish(spark, jobs.distinct_conversations(land(rows)), tmp_path)
    assert sorted(r["conversation_id"] for r in got.collect()) == ["a", "b"]


def test_sliding_alerts(spark, land, tmp_path):
    rows = [{"timestamp": NOW, "latency_ms": 900.0}, {"timestamp": NOW + timedelta(hours=6)}]
    got = finish(spark, jobs.sliding_alerts(land(rows), 800.0, 50.0), tmp_path).collect()
    assert sorted(r["window_start"] for r in got) == [NOW - timedelta(minutes=m) for m in (45, 30, 15, 0)]


def test_sessions_on_stream_and_table_agree(spark, land, make_calls, tmp_path):
    rows = [{"user_id": "u", "timestamp": NOW + timedelta(minutes=m)} for m in (0, 29, 70, 400)]
    streamed = finish(spark, jobs.user_sessions(jobs.event_time(land(rows))), tmp_path).collect()
    whole = jobs.user_sessions(make_calls(rows).withColumn("ts", F.col("timestamp").cast("timestamp"))).collect()
    assert sorted(r["requests"] for r in whole) == [1, 1, 2]
    assert set(streamed) == {r for r in whole if r["session_start"] < NOW + timedelta(minutes=400)}


def test_scores_join_within_their_time(spark, land, make_evals, tmp_path):
    calls = land([{}, {}, {}])
    folder = str(tmp_path / "evals")
    scores = make_evals([(1, "human", 0.1), (2, "human", 0.2), (9, "human", 0.3)])
    late = F.when(F.col("completion_id") == 2, F.lit(NOW + timedelta(hours=2))).otherwise(F.col("created_at"))
    scores.withColumn("created_at", late).write.parquet(folder)
    stream = spark.readStream.schema(schemas.EVALS).parquet(folder)
    got = finish(spark, jobs.scores_in_time(calls, stream), tmp_path, "join").collect()
    assert [r["completion_id"] for r in got] == [1]


def test_late_rows_are_set_apart(spark, land, tmp_path):
    paths = [str(tmp_path / n) for n in ("on_time", "late", "progress", "cp")]
    stream = land([{"timestamp": NOW}])
    jobs.split_late(stream, *paths).awaitTermination()
    land(
        [
            {"timestamp": NOW - timedelta(minutes=61)}, {"timestamp": NOW - timedelta(minutes=59)},
            {"timestamp": NOW + timedelta(hours=9)},
        ],
        first=10,
    )
    jobs.split_late(stream, *paths).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == [1, 12, 13]
    assert [r["id"] for r in spark.read.parquet(paths[1]).collect()] == [11]
