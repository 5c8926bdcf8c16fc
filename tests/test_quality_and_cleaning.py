import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from calltally.functions import numbers, pricing, times
from calltally.operators import cleaning, etl, quality
from tests.conftest import dicts


@pytest.mark.parametrize(
    "change,reasons",
    [
        ({}, []),
        ({"prompt": "", "response": ""}, []),
        ({"prompt": None}, ["prompt missing"]),
        ({"tokens_in": 0}, ["tokens_in must be > 0"]),
        ({"tokens_out": -1}, ["tokens_out must be > 0"]),
        ({"latency_ms": 0.0}, ["latency_ms must be > 0"]),
        ({"cost_usd": 0.0}, []),
        ({"cost_usd": -0.01, "model": None}, ["model missing", "cost_usd must be >= 0"]),
    ],
)
def test_completion_contract(make_calls, change, reasons):
    row = quality.with_reasons(make_calls([change]), quality.completion_rules()).first()
    assert row["reasons"] == reasons


@pytest.mark.parametrize(
    "kind,score,valid",
    [("bleu", 0.0, True), ("human", 1.0, True), ("human", 1.5, False), ("human", -0.1, False), ("vibes", 0.5, False), ("rules", None, False)],
)
def test_eval_contract(make_evals, kind, score, valid):
    good, bad = quality.split_valid(make_evals([(1, kind, score)]), quality.eval_rules())
    assert (good.count(), bad.count()) == ((1, 0) if valid else (0, 1))


def test_batch_rules(spark, make_calls):
    def batch(name, good, bad):
        return make_calls([{}] * good + [{"tokens_in": 0}] * bad).withColumn("b", F.lit(name))

    sent = batch("full", 1000, 0)
    for part in (batch("big", 1001, 0), batch("some", 10, 50), batch("many", 10, 51)):
        sent = sent.unionByName(part)
    good, bad, status = quality.accept_batches(sent, "b", quality.completion_rules())
    got = {r["b"]: (r["status"], r["ingested_count"], r["failed_count"]) for r in status.collect()}
    assert got == {
        "full": ("success", 1000, 0), "big": ("refused", 0, 0), "some": ("success", 10, 50), "many": ("rollback", 0, 51),
    }
    assert {r["b"]: r["count"] for r in good.groupBy("b").count().collect()} == {"full": 1000, "some": 10}
    assert {r["b"]: r["count"] for r in bad.groupBy("b").count().collect()} == {"some": 50, "many": 51}


def test_audit_passes_undecided_rules(spark):
    rows = spark.createDataFrame([(0.5, None), (None, 1.0), (1.5, -1.0)], "score double, raw_score double")
    got = {r["rule"]: r["violations"] for r in quality.audit(rows, quality.eval_checks()).collect()}
    assert got == {"score_in_range": 1, "raw_score_not_negative": 1}


def test_orphans_and_repeats(spark, make_calls, make_evals):
    orphans = quality.orphan_evals(make_evals([(1, "human", 0.5), (9, "human", 0.5)]), make_calls([{}]))
    assert [r["completion_id"] for r in orphans.collect()] == [9]
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert dicts(quality.repeated_keys(keys, F.col("k"), "k")) == [{"key_name": "k", "key": "a", "occurrences": 2}]


NUMBERS = [
    ("12.7", 12.7, 12), ("", -1.0, -1), ("  8 ", 8.0, 8), ("abc", -1.0, -1), ("1e2", 100.0, 100), ("nan", -1.0, -1),
    ("inf", -1.0, -1), ("12d", -1.0, -1), ("-3.9", -3.9, -3), ("+.5", 0.5, 0), (None, -1.0, -1), ("1e400", -1.0, -1),
    ("99999999999", 99999999999.0, -1),
]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in NUMBERS], "t string")
    got = df.select(
        numbers.parse_float(F.col("t"), F.lit(-1)).alias("f"), numbers.parse_int(F.col("t"), F.lit(-1)).alias("i")
    ).collect()
    assert [(r["f"], r["i"]) for r in got] == [(f, i) for _, f, i in NUMBERS]


TIMES = {
    "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05+02:00": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02 03:04:05.25": datetime(2024, 1, 2, 3, 4, 5, 250000),
    "2024-01-02T03:04:05 or so": datetime(2024, 1, 2, 3, 4, 5),
    "2024-01-02": datetime(2024, 1, 2),
    "2024": None,
    "soon": None,
}


def test_wall_clock(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r["t"]: r["at"] for r in df.select("t", times.wall_clock(F.col("t")).alias("at")).collect()}
    assert got == TIMES


def test_backfill_stays_within_a_week_and_repeats(spark):
    anchor = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(500).select(cleaning.backfilled_time(F.lit(None).cast("string"), F.col("id"), anchor).alias("at"))
    first, second = [r["at"] for r in rows.collect()], [r["at"] for r in rows.collect()]
    assert first == second and len(set(first)) > 450
    assert min(first) >= datetime(2024, 1, 25) and max(first) <= datetime(2024, 2, 1)


def test_imputation_ranges(spark):
    rows = spark.range(2000).select(
        cleaning.imputed_latency(F.lit("GPT-4"), F.col("id")).alias("known"),
        cleaning.imputed_latency(F.lit("unheard"), F.col("id")).alias("other"),
        cleaning.imputed_tokens_in(F.lit(None), F.col("id")).alias("i"),
        cleaning.imputed_tokens_out(F.lit(None), F.col("id")).alias("o"),
    )
    low = rows.agg(*[F.min(c) for c in rows.columns]).first()
    high = rows.agg(*[F.max(c) for c in rows.columns]).first()
    assert 250 <= low[0] < 260 and 590 < high[0] <= 600
    assert 500 <= low[1] and high[1] <= 2000
    assert (low[2], high[2], low[3], high[3]) == (50, 500, 20, 300)


def test_prices(spark):
    rows = [("GPT-4", 0.09), ("nobody", 0.003), ("mistral-large", 0.0), ("claude-3-opus", 0.09)]
    df = spark.createDataFrame(rows, "model string, want double")
    got = df.withColumn("got", pricing.cost(F.lit(1000), F.lit(1000), F.col("model")))
    assert all(r["got"] == r["want"] for r in got.collect())
    joined = pricing.with_prices(df, pricing.price_table(spark)).collect()
    assert all(r["price_in"] + r["price_out"] == pytest.approx(r["want"]) for r in joined)


def test_ratings(spark):
    rows = [(8.0, 0.8), (1.0, 1.0), (0.4, 0.4), (12.0, 1.0), (-3.0, 0.0), (None, None)]
    df = spark.createDataFrame(rows, "r double, want double")
    got = df.withColumn("got", cleaning.upload_rating(F.col("r")))
    assert [r["got"] for r in got.collect()] == [pytest.approx(w) if w is not None else None for _, w in rows]
    assert spark.range(1).select(cleaning.benchmark_rating(F.lit(None).cast("double"))).first()[0] == 0.5


def test_first_row_per_key_is_kept_whole(spark):
    rows = [("a", 5, None), ("a", 2, "first"), ("b", 1, None), ("a", 9, "late")]
    df = spark.createDataFrame(rows, "k string, seq int, v string").repartition(3)
    assert {(r["k"], r["seq"], r["v"]) for r in cleaning.first_per_key(df, "k", "seq").collect()} == {
        ("a", 2, "first"), ("b", 1, None),
    }


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_neighbours_equal_one_window_per_group(spark, stretch):
    """A hot group with gaps, and small groups; the stretched form changes nothing."""
    rng = random.Random(11)
    rows = [("hot", t, f"h{t}") for t in rng.sample(range(-40, 2000), 300)]
    rows += [(f"g{i}", t, f"{i}-{t}") for i in range(40) for t in rng.sample(range(30), rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "g string, t bigint, v string")
    w = Window.partitionBy("g").orderBy("t")
    want = df.select("g", "t", "v", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v"))
    got = cleaning.with_neighbours(df, "g", "t", ["v"], stretch)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_flat_messages(spark):
    df = spark.sql(
        "SELECT array(struct('user' AS role, 'a' AS content), struct('user' AS role, cast(NULL AS string) AS content)) AS m,"
        " array(struct('x' AS text), struct(cast(NULL AS string) AS text), struct('y' AS text)) AS b"
    )
    row = cleaning.flatten_messages(df, "m", "b").first()
    assert (row["prompt"], row["response"]) == ("a ", "x y")


def battle_rows(spark, rows):
    names = "seq bigint, conversation_id string, model_a string, model_b string, winner string, language string, timestamp string, tokens_in int, tokens_out int, latency_ms double, cost_usd double"
    return spark.createDataFrame(rows, names)


def test_battle_sides(spark):
    rows = [
        (0, "c1", "gpt-4", "palm-2", "model_a", "English", "2024-01-02T03:04:05Z", 10, 20, 500.0, 0.01),
        (1, "c1", "x", "y", "model_b", "English", "2024-01-02T03:04:05Z", 1, 1, 1.0, 1.0),
        (2, None, "gpt-4", "palm-2", "both_bad", None, "?", None, None, None, None),
        (3, "c3", "gpt-4", "palm-2", "tie", "German", "2024-01-02T03:04:05Z", 1000, 1000, 5.0, None),
    ]
    sides = {r["id"]: r for r in etl.battle_sides(battle_rows(spark, rows), "2024-02-01 00:00:00").collect()}
    assert sorted(sides) == [0, 1, 4, 5, 6, 7]
    assert (sides[0]["score"], sides[1]["score"]) == (1.0, 0.0)
    assert (sides[0]["cost_usd"], sides[1]["cost_usd"]) == (0.01, 0.008)
    assert sides[1]["conversation_id"] == "c1_b" and sides[0]["latency_ms"] == sides[1]["latency_ms"] == 500.0
    assert sides[0]["prompt"] == "[English] Arena battle: gpt-4 vs palm-2" and sides[0]["response"] == "Winner: model_a"
    assert (sides[4]["score"], sides[5]["score"]) == (0.0, 0.0)
    assert sides[4]["conversation_id"] == "lmsys_2" and 50 <= sides[4]["tokens_in"] <= 500
    assert sides[4]["latency_ms"] == 500.0
    assert (sides[6]["score"], sides[7]["score"], sides[6]["cost_usd"]) == (0.5, 0.5, 0.09)
    assert sides[7]["cost_usd"] == pytest.approx(0.072)


def test_one_side_per_battle(spark):
    rows = [(i, f"c{i}", "gpt-4", "palm-2", "tie", "English", "?", None, None, None, None) for i in range(300)]
    calls = etl.single_model_calls(battle_rows(spark, rows), "2024-02-01 00:00:00").collect()
    assert len(calls) == 300 and 90 < sum(r["model"] == "gpt-4" for r in calls) < 210
    for r in calls:
        low, high = (250, 600) if r["model"] == "gpt-4" else (350, 900)
        assert low <= r["latency_ms"] <= high


def test_rating_tiers(spark):
    df = spark.sql(
        "SELECT 'p' AS prompt, 'c' AS criteria, array(' a ', 'b') AS excellent, array('m') AS mediocre, array('x', 'y', 'z') AS poor"
    )
    rows = dicts(etl.expand_rating_tiers(df))
    assert len(rows) == 6
    by_text = {r["response"]: r["quality_rating"] for r in rows}
    assert 8 <= by_text["a"] <= 10 and 4 <= by_text["m"] <= 7 and 1 <= by_text["x"] <= 3
    assert {r["human_rater"] for r in rows} <= {"alice", "bob", "carol", "david", "eve"}
