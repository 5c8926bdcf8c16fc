import json

import pytest
from pyspark.sql import functions as F

from calltally import schemas
from calltally.operators import etl, evaluations
from calltally.sources import files, tables
from tests.conftest import dicts
from tests.test_quality_and_cleaning import battle_rows

ANCHOR = "2024-02-01 00:00:00"


@pytest.fixture()
def csv(tmp_path):
    def write(content, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def loaded(spark, path):
    return etl.upload_rows(files.read_upload_csv(spark, path), "upload_x", ANCHOR)


def test_minimal_upload(spark, csv):
    rows = loaded(spark, csv("prompt,response\nWhat is Python?,Python is a programming language.\n"))
    (row,) = dicts(rows)
    assert (row["model"], row["source"], row["tokens_in"], row["tokens_out"]) == ("uploaded", "upload_x", 3, 6)
    assert {r["eval_type"] for r in etl.upload_evals(rows, ANCHOR).collect()} == {"bleu", "rouge"}


def test_missing_column_is_named(spark, csv):
    with pytest.raises(ValueError, match="response"):
        files.read_upload_csv(spark, csv("prompt,model\na,b\n"))


def test_header_only_is_an_error(spark, csv):
    with pytest.raises(ValueError, match="no data rows"):
        files.read_upload_csv(spark, csv("prompt,response\n"))


def test_blank_rows_are_an_error_when_nothing_is_left(spark, csv):
    rows = files.read_upload_csv(spark, csv("prompt,response\n , \n\t,x\n"))
    with pytest.raises(ValueError, match="both a prompt"):
        files.usable_rows(rows)


def test_ratings_models_and_optional_columns(spark, csv):
    content = (
        "prompt,response,model,tokens_in,tokens_out,latency_ms,cost_usd,quality_rating,criteria\n"
        "a b,a c,gpt-4,50,30,120.5,0.002,8,clear\n"
        "a,b,claude-3-opus,,,,,10,\n"
        "a,b,,x,y,z,w,not_a_number,\n"
    )
    rows = loaded(spark, csv(content))
    first, second, third = sorted(dicts(rows), key=lambda r: r["id"])
    assert (first["tokens_in"], first["tokens_out"], first["latency_ms"], first["cost_usd"]) == (50, 30, 120.5, 0.002)
    assert (second["tokens_in"], second["latency_ms"]) == (1, 0.0)
    assert third["model"] == "uploaded" and third["_human"] is None
    scores = dicts(etl.upload_evals(rows, ANCHOR))
    assert sorted(r["score"] for r in scores if r["eval_type"] == "human") == [0.8, 1.0]
    assert len(scores) == 8 and len({r["id"] for r in scores}) == 8
    (bleu,) = [r for r in scores if r["eval_type"] == "bleu" and r["completion_id"] == first["id"]]
    assert bleu["criteria"] == "clear" and bleu["source"] == "computed"


def test_header_noise_quotes_and_short_rows(spark, csv):
    content = "﻿ Prompt ,RESPONSE,Model\n\"line one\nline, two\",\"say \"\"hi\"\"\",gpt-4\nshort,row\n"
    rows = sorted(dicts(files.read_upload_csv(spark, csv(content.encode("utf-8")))), key=lambda r: r["_seq"])
    assert rows[0]["prompt"] == "line one\nline, two" and rows[0]["response"] == 'say "hi"'
    assert (rows[1]["prompt"], rows[1]["response"], rows[1]["model"]) == ("short", "row", "")


def test_optional_row_limit(spark, csv):
    path = csv("prompt,response\n" + "a,b\n" * 50)
    assert files.read_upload_csv(spark, path).count() == 50
    assert files.read_upload_csv(spark, path, limit=7).count() == 7


def test_battle_file(spark, csv):
    path = csv(
        "conversation_id,model_a,model_b,winner,language,timestamp,tokens_in,tokens_out,latency_ms,cost_usd\n"
        "c1,gpt-4,palm-2,tie,English,2024-01-01T00:00:00Z,10,20,500,0.01\n"
        "c2,gpt-4,palm-2,model_b,English,2024-01-01T00:00:00Z,,,,\n"
    )
    rows = sorted(dicts(files.read_battles_csv(spark, path)), key=lambda r: r["seq"])
    assert rows[0]["latency_ms"] == 500.0 and rows[1]["tokens_in"] is None
    assert files.read_battles_csv(spark, path, rows=1).count() == 1


def test_undelivered_calls(spark, csv):
    call = {"prompt": "p", "response": "r", "model": "m", "tokens_in": 3, "tokens_out": 4, "latency_ms": 5.5, "cost_usd": 0}
    lines = [
        json.dumps({"path": "/api/v1/logs", "payload": call, "ts": "2024-01-01T00:00:00+00:00"}),
        json.dumps({"path": "/api/v1/logs/batch", "payload": [call, {**call, "tokens_in": "bad"}], "ts": "t"}),
        "{broken",
        "",
    ]
    rows = dicts(files.replay_undelivered(spark, csv("\n".join(lines), "log.jsonl")))
    assert sorted(str(r["tokens_in"]) for r in rows) == ["3.0", "3.0", "None"]
    assert all(r["model"] == "m" and r["latency_ms"] == 5.5 for r in rows)


def stored(spark, root):
    return (
        tables.read_table(spark, f"{root}/completions", schemas.COMPLETIONS),
        tables.read_table(spark, f"{root}/evals", schemas.EVALS),
    )


@pytest.fixture()
def arena_rows(spark):
    return battle_rows(
        spark,
        [
            (i, f"c{i}", "gpt-4", "palm-2", ("model_a", "model_b", "tie")[i % 3], "English", "2024-01-02T03:04:05Z", 10, 20, 500.0, 0.01)
            for i in range(30)
        ],
    )


def test_loading_twice_changes_nothing(spark, arena_rows, tmp_path):
    root = str(tmp_path / "t")
    for _ in range(2):
        tables.load_battles(arena_rows, root, ANCHOR)
    calls, scores = stored(spark, root)
    assert calls.count() == 60 and scores.count() == 60
    assert scores.join(calls, scores["completion_id"] == calls["id"]).count() == 60
    tables.load_battles(arena_rows, root, ANCHOR, batch_id="more", first_id=tables.next_id(calls))
    assert stored(spark, root)[0].select("id").distinct().count() == 120


def test_reload_keeps_ids_apart(spark, arena_rows, tmp_path):
    bench = spark.createDataFrame(
        [(0, "a b c", "a b", "8", "c", "eve"), (1, "x", "y", None, None, None)],
        "seq bigint, prompt string, response string, quality_rating string, criteria string, human_rater string",
    )
    root = str(tmp_path / "t")
    tables.reload_all(arena_rows, bench, root, ANCHOR)
    calls, scores = stored(spark, root)
    assert calls.count() == 62 and calls.select("id").distinct().count() == 62
    got = {(r["eval_type"], r["score"]) for r in scores.where("eval_type = 'human'").collect()}
    assert got == {("human", 0.8), ("human", 0.5)}
    report = {(r["scope"], r["key"]): r["count"] for r in dicts(evaluations.load_report(scores, calls))}
    assert report[("completions", "")] == 62 and report[("source", "evals_benchmark")] == 2
    assert report[("eval_type", "bleu")] == 2


def test_upload_lifecycle(spark, csv, tmp_path):
    root = str(tmp_path / "t")
    source = tables.dataset_id("data.csv", ANCHOR)
    assert source.startswith("upload_") and source == tables.dataset_id("data.csv", ANCHOR)
    rows = files.read_upload_csv(spark, csv("prompt,response,quality_rating\na b,a b,9\nc,d,\n"))
    for _ in range(2):
        tables.load_upload(rows, root, source, "data.csv", ANCHOR)
    calls, scores = stored(spark, root)
    uploads = tables.read_table(spark, f"{root}/uploads", schemas.UPLOADS)
    (entry,) = dicts(uploads)
    assert (entry["row_count"], entry["has_quality_rating"], entry["has_model_column"]) == (2, True, False)
    listing = {r["eval_type"]: r["avg_score"] for r in dicts(evaluations.dataset_listing(uploads, scores, calls))}
    assert listing == {"bleu": 0.5, "rouge": 0.5, "human": 0.9}
    with pytest.raises(LookupError):
        tables.without_dataset(uploads, calls, scores, 123)
    kept = tables.without_dataset(uploads, calls, scores, entry["id"])
    assert [t.count() for t in kept] == [0, 0, 0]
    # a row without a source is of no dataset
    stray = calls.limit(1).withColumns({"id": F.lit(999).cast("long"), "source": F.lit(None).cast("string")})
    kept = tables.without_dataset(uploads, calls.unionByName(stray), scores, entry["id"])
    assert [r["id"] for r in kept[1].collect()] == [999]


def test_header_cells_with_dots_and_backquotes(spark, csv):
    rows = files.read_upload_csv(spark, csv("prompt,response,meta.kind,`x\na,b,c,d\ne,f,,g\n"))
    assert [tuple(r) for r in rows.orderBy("_seq").collect()] == [("a", "b", "c", "d", 0), ("e", "f", "", "g", 1)]
    assert rows.columns == ["prompt", "response", "meta.kind", "`x", "_seq"]


def test_two_uploads_of_one_file_name_both_stay(spark, csv, tmp_path):
    root = str(tmp_path / "t")
    for at, text in (("2024-02-01 00:00:00", "a,b"), ("2024-02-02 00:00:00", "c,d\ne,f")):
        rows = files.read_upload_csv(spark, csv(f"prompt,response\n{text}\n"))
        first = 100 if at > "2024-02-01 12" else 0
        tables.load_upload(rows, root, tables.dataset_id("data.csv", at), "data.csv", at, first)
    entries = dicts(tables.read_table(spark, f"{root}/uploads", schemas.UPLOADS))
    assert sorted(r["row_count"] for r in entries) == [1, 2] and len({r["id"] for r in entries}) == 2
    assert stored(spark, root)[0].count() == 3


def test_reload_leaves_nothing_else(spark, csv, arena_rows, tmp_path):
    root = tmp_path / "t"
    rows = files.read_upload_csv(spark, csv("prompt,response\na,b\n"))
    tables.load_upload(rows, str(root), "upload_x", "data.csv", ANCHOR)
    bench = spark.createDataFrame(
        [(0, "x", "y", None, None, None)],
        "seq bigint, prompt string, response string, quality_rating string, criteria string, human_rater string",
    )
    tables.reload_all(arena_rows, bench, str(root), ANCHOR)
    assert {r["source"] for r in stored(spark, str(root))[0].collect()} == {"lmsys", "evals_benchmark"}
    assert sorted(p.name for p in root.iterdir()) == ["completions", "evals"]


def test_columns_go_by_name_in_every_file(spark, csv, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "b.csv").write_text("response,Prompt,extra\nr2,p2,x\n" + "".join(f"r{i},p{i},\n" for i in range(3, 400)))
    (folder / "a.csv").write_text("prompt,response\np0,r0\np1,r1\n")
    rows = files.read_upload_csv(spark, str(folder)).orderBy("_seq").collect()
    assert [r["_seq"] for r in rows] == list(range(400))
    assert all((r["prompt"], r["response"]) == (f"p{i}", f"r{i}") for i, r in enumerate(rows))
    assert (rows[0]["extra"], rows[2]["extra"]) == ("", "x")
    assert [r["prompt"] for r in files.read_upload_csv(spark, str(folder), limit=3).orderBy("_seq").collect()] == ["p0", "p1", "p2"]


def test_battle_columns_go_by_name_and_may_be_absent(spark, csv):
    path = csv("model_b,latency_ms,model_a,unknown\npalm-2,7.5,gpt-4,?\n")
    (row,) = dicts(files.read_battles_csv(spark, path))
    assert (row["model_a"], row["model_b"], row["latency_ms"]) == ("gpt-4", "palm-2", 7.5)
    assert (row["winner"], row["language"], row["conversation_id"], row["seq"]) == ("tie", "English", None, 0)
    with pytest.raises(ValueError, match="model_b"):
        files.read_battles_csv(spark, csv("model_a,winner\na,tie\n"))
    with pytest.raises(ValueError, match="named twice"):
        files.read_battles_csv(spark, csv("model_a,model_b, MODEL_A\na,b,c\n"))


def test_line_ends_in_cells_are_refused_line_by_line(spark, csv):
    path = csv('prompt,response\n"a\nb",c\n')
    assert files.read_upload_csv(spark, path).count() == 1
    with pytest.raises(ValueError, match="multi_line"):
        files.read_upload_csv(spark, path, multi_line=False)


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    folder = tmp_path / "split"
    folder.mkdir()
    (folder / "1.csv").write_text("model_a,model_b\n" + "".join(f"a{i},b\n" for i in range(50)))
    (folder / "2.csv").write_text("model_a,model_b\n" + "".join(f"a{50 + i},b\n" for i in range(3000)))
    wanted = [f"a{i}" for i in range(3050)]
    for size in ("134217728", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_battles_csv(spark, str(folder)).orderBy("seq").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r["model_a"] for r in rows] == wanted and [r["seq"] for r in rows] == list(range(3050))


def test_upload_without_usable_rows_stores_nothing(spark, csv, tmp_path):
    root = tmp_path / "t"
    rows = files.read_upload_csv(spark, csv("prompt,response\n , \n"))
    with pytest.raises(ValueError, match="both a prompt"):
        tables.load_upload(rows, str(root), "upload_y", "data.csv", ANCHOR)
    assert not (root / "completions").exists() and not (root / "uploads").exists()


def test_files_are_sorted_by_model_and_time(spark, make_calls, tmp_path):
    rows = [{"model": m, "timestamp": t} for t in reversed(_days(1, 1, 2)) for m in ("b", "a", "c")]
    path = str(tmp_path / "c")
    tables.append_completions(make_calls(rows).repartition(3), path, "1")
    stored = spark.read.parquet(path).where("date = '2024-01-01'").withColumn("f", F.input_file_name())
    for names in stored.groupBy("f").agg(F.collect_list("model").alias("m")).collect():
        assert names["m"] == sorted(names["m"])


def test_outside_scores_are_checked(spark, make_evals, tmp_path):
    path = str(tmp_path / "evals")
    rejected = tables.record_evals(make_evals([(1, "human", 0.5), (2, "human", 7.0)]), path, "b1")
    assert [r["reasons"] for r in rejected.collect()] == [["score must lie in 0..1"]]
    assert tables.read_table(spark, path, schemas.EVALS).count() == 1


def test_refresh_replaces_only_touched_days(spark, make_calls, tmp_path):
    path = str(tmp_path / "daily")
    calls = make_calls([{"timestamp": d} for d in _days(1, 2, 3)])
    tables.refresh_daily(calls, path)
    more = make_calls([{"timestamp": d} for d in _days(1, 2, 2, 3, 3)])
    tables.refresh_daily(more, path, ["2024-01-02"])
    got = {str(r["date"]): r["request_count"] for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1}


def _days(*days):
    from datetime import datetime

    return [datetime(2024, 1, day, 12) for day in days]


def test_retention_splits_at_the_day(spark, make_calls):
    calls = make_calls([{"timestamp": d} for d in _days(1, 2, 3)])
    old, kept = tables.split_by_age(calls, "2024-01-02")
    assert (old.count(), kept.count()) == (1, 2)


def test_numeric_looking_sources_stay_text(spark, make_calls, tmp_path):
    path = str(tmp_path / "c")
    tables.append_completions(make_calls([{"source": "007"}]), path, "1")
    assert tables.read_table(spark, path, schemas.COMPLETIONS).first()["source"] == "007"


def test_exports_round_trip(spark, make_calls, tmp_path):
    rows = make_calls([{"prompt": ' a,"b"\nc ', "response": ""}]).select("id", "prompt", "latency_ms")
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(rows.schema).csv(str(tmp_path / "csv"))
    assert dicts(back) == dicts(rows)
    files.write_json(rows, str(tmp_path / "json"))
    assert dicts(spark.read.schema(rows.schema).json(str(tmp_path / "json")).select(*rows.columns)) == dicts(rows)


def test_long_scores(spark):
    wide = spark.createDataFrame([(1, 0.1, 0.2)], "id bigint, bleu double, rouge double")
    assert sorted((r["eval_type"], r["score"]) for r in etl.long_scores(wide, "id", ["bleu", "rouge"]).collect()) == [
        ("bleu", 0.1), ("rouge", 0.2),
    ]


def test_tagged_union(spark):
    one = spark.range(2).select(F.col("id"))
    assert sorted(r["source"] for r in etl.tagged_union({"a": one, "b": one}).collect()) == ["a", "a", "b", "b"]
