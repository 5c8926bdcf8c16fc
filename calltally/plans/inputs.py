"""The driver tables seen as completions, scores, battles, pairs, spans and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import pricing
from calltally.operators import cleaning

ANCHOR = "2024-02-01 00:00:00"
LANGUAGES = ("English", "German", "French")


# Schemas of the driver tables; naming them saves the footer-reading job per query.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def completions_from(events: DataFrame) -> DataFrame:
    """Calls derived from event rows; works on a table and on a stream."""
    base = events.selectExpr(
        "event_id AS id",
        "ts AS timestamp",
        "concat('call ', cast(event_id AS string), repeat(' and more', cast(event_id % 29 AS int)))"
        " AS prompt",
        "concat('answer ', props) AS response",
        "CASE event_type WHEN 'view' THEN 'gpt-4' WHEN 'click' THEN 'gpt-3.5-turbo'"
        " WHEN 'signup' THEN 'claude-3-opus' WHEN 'purchase' THEN 'mistral-large'"
        " ELSE 'unlisted-model' END AS model",
        "cast(get_json_object(props, '$.k') AS int) + 1 AS tokens_in",
        "cast(event_id % 97 AS int) AS tokens_out",
        "value * 10 + (event_id % 1009) / 1013 AS latency_ms",
        "CASE WHEN event_id % 53 <> 0 THEN concat('user_', cast(user_id AS string)) END AS user_id",
        "concat('conv_', cast(event_id div 2 AS string)) AS conversation_id",
        f"CASE event_id % 10 WHEN 0 THEN '{values.BENCHMARK}' WHEN 1 THEN 'upload_a'"
        f" ELSE '{values.ARENA}' END AS source",
        "event_id % 97 > 0 AS success",
        "CASE WHEN event_id % 97 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'timeout'"
        " WHEN 1 THEN 'rate_limit' ELSE 'server_error' END END AS error_code",
        "(event_id % 26) / 10 AS temperature",
    )
    cost = pricing.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("model"))
    return base.withColumn("cost_usd", cost)


def completions(spark: SparkSession, folder: str) -> DataFrame:
    return completions_from(table(spark, folder, "events"))


def evals_from(events: DataFrame) -> DataFrame:
    """Scores derived from event rows: preferences in the arena, human and judge scores elsewhere,
    and some scores whose completion does not exist."""

    def entry(at: int, when: str, target: str, kind: str, score: str, source: str) -> str:
        return (
            f"CASE WHEN {when} THEN struct(event_id * 4 + {at} AS id, {target} AS completion_id,"
            f" '{kind}' AS eval_type, {score} AS score, '{source}' AS source) END"
        )

    entries = (
        entry(0, "event_id % 10 > 1", "event_id", values.PREFERENCE, "(event_id % 3) / 2", values.PREFERENCE),
        entry(1, "event_id % 10 <= 1", "event_id", "human", "(event_id % 129) / 128", "benchmark"),
        entry(
            2, "event_id % 10 <= 1 AND event_id % 7 <> 3", "event_id", "llm_judge",
            "(event_id * 7 % 129) / 128", "benchmark",
        ),
        entry(3, "event_id % 50 = 49", "event_id + 10000000000", "rules", "(event_id % 5) / 4", "computed"),
    )
    rows = f"inline(array_compact(array({', '.join(entries)})))"
    scored = events.selectExpr(
        "ts + make_dt_interval(0, 0, cast(event_id % 90 AS int)) AS created_at", rows
    )
    return scored.selectExpr(
        "id", "completion_id", "eval_type", "score", "cast(NULL AS string) AS criteria",
        "cast(NULL AS string) AS explanation", "created_at", "source",
    )


def evals(spark: SparkSession, folder: str) -> DataFrame:
    return evals_from(table(spark, folder, "events"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A registry whose row counts come from the completions; `upload_b` has no rows there."""
    counted = completions(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))
    entries = spark.sql(
        f"""SELECT * FROM VALUES
          (1L, 'upload_a', 'a.csv', true, true, '2024-02-01 10:00:00'),
          (2L, '{values.BENCHMARK}', 'bench.csv', true, false, '2024-02-02 10:00:00'),
          (3L, 'upload_b', 'b.csv', false, false, '2024-02-03 10:00:00')
        AS t(id, source_id, filename, has_quality_rating, has_model_column, created_at)"""
    )
    return entries.join(counted, entries["source_id"] == counted["source"], "left").select(
        "id",
        "source_id",
        "filename",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "has_quality_rating",
        "has_model_column",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def battles(spark: SparkSession, folder: str) -> DataFrame:
    """Arena battles from orders: repeated conversations, missing cells, several time formats."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 13 <> 0 THEN"
        " concat('lmsys_', cast(o_orderkey - o_orderkey % 3 AS string)) END AS conversation_id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'gpt-4' WHEN '2-HIGH' THEN 'claude-3-opus'"
        " WHEN '3-MEDIUM' THEN 'gpt-3.5-turbo' WHEN '4-NOT SPECIFIED' THEN 'gemini-pro'"
        " ELSE 'Unlisted-Model' END AS model_a",
        "CASE o_custkey % 4 WHEN 0 THEN 'llama-2-70b' WHEN 1 THEN 'palm-2' WHEN 2 THEN 'gpt-4-turbo'"
        " ELSE 'mistral-large' END AS model_b",
        "CASE WHEN o_custkey % 11 = 0 THEN 'both_bad' WHEN o_orderstatus = 'F' THEN 'model_a'"
        " WHEN o_orderstatus = 'O' THEN 'model_b' ELSE 'tie' END AS winner",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Klingon' WHEN 1 THEN 'German' WHEN 2 THEN 'French'"
        " ELSE 'English' END AS language",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE concat(date_format("
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 30 AS int), 0, 0,"
        " cast(o_custkey * 7 % 86400 AS decimal(18,6))), \"yyyy-MM-dd'T'HH:mm:ss\"),"
        " CASE o_orderkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN ''"
        " ELSE '.250000+05:30' END) END AS timestamp",
        "CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_custkey % 400 + 20 AS int) END AS tokens_in",
        "CASE WHEN o_orderkey % 8 <> 0 THEN cast(o_custkey % 250 + 10 AS int) END AS tokens_out",
        "CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_custkey % 900 + 100 AS double) END AS latency_ms",
        "CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 10000000 END AS cost_usd",
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turn and the assistant turn that follows it, with a numeric id."""
    found = cleaning.prompt_response_pairs(table(spark, folder, "conversations"))
    return found.withColumn("id", F.col("conv_id") * 1_000_000 + F.col("turn"))


def uploaded_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as the text cells of an uploaded file, with blank, padded and broken cells."""
    return pairs(spark, folder).selectExpr(
        "id AS _seq",
        "CASE WHEN conv_id % 9 = 0 THEN ' \\t ' ELSE prompt END AS prompt",
        "concat('  ', response, ' ') AS response",
        "CASE WHEN id % 7 = 0 THEN '  ' WHEN id % 7 < 4 THEN 'gpt-4' ELSE ' claude-3-opus ' END AS model",
        "CASE id % 7 WHEN 1 THEN '12.7' WHEN 2 THEN 'oops' WHEN 3 THEN '' ELSE '80' END AS tokens_in",
        "CASE id % 7 WHEN 4 THEN '1e2' WHEN 5 THEN 'nan' ELSE ' 33 ' END AS tokens_out",
        "CASE id % 7 WHEN 6 THEN 'x' ELSE '120.5' END AS latency_ms",
        "CASE id % 7 WHEN 5 THEN 'inf' ELSE '0.002' END AS cost_usd",
        "CASE id % 7 WHEN 0 THEN '8' WHEN 1 THEN '1' WHEN 2 THEN '0.4' WHEN 3 THEN 'not_a_number'"
        " WHEN 4 THEN '-3' WHEN 5 THEN '12' ELSE '' END AS quality_rating",
        "CASE WHEN id % 7 < 3 THEN ' clarity ' ELSE '' END AS criteria",
    )


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as root spans and line items as their children."""
    roots = table(spark, folder, "orders").selectExpr(
        "concat('o', cast(o_orderkey AS string)) AS id",
        "cast(NULL AS string) AS parent_trace_id",
        "'request' AS trace_type",
        "o_orderpriority AS span_name",
        "o_orderdate AS start_time",
        "o_orderdate + make_dt_interval(0, 0, 0, cast(o_custkey % 100 AS decimal(18,6))) AS end_time",
        "CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status",
        "to_json(struct(o_orderstatus AS status, o_custkey AS customer)) AS trace_data",
    )
    children = table(spark, folder, "lineitem").selectExpr(
        "concat_ws('_', concat('l', cast(l_orderkey AS string)), cast(l_linenumber AS string),"
        " cast(l_partkey AS string), cast(l_suppkey AS string)) AS id",
        "concat('o', cast(l_orderkey AS string)) AS parent_trace_id",
        "'span' AS trace_type",
        "concat(l_returnflag, l_linestatus) AS span_name",
        "l_shipdate AS start_time",
        "l_shipdate + make_dt_interval(0, 0, 0, cast(l_quantity"
        " - CASE WHEN l_partkey % 50 = 0 THEN 60 ELSE 0 END AS decimal(18,6))) AS end_time",
        "CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status",
        "to_json(struct(l_partkey AS part)) AS trace_data",
    )
    return roots.unionByName(children)


def nested_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Orders under orders of half their key and line items under earlier ones of their order: deep trees,
    some with a parent that does not exist, some below a span that is its own parent."""
    orders = table(spark, folder, "orders").selectExpr(
        "concat('o', cast(o_orderkey AS string)) AS id",
        "CASE WHEN o_orderkey % 1009 = 5 THEN concat('o', cast(o_orderkey AS string)) WHEN o_orderkey % 97 = 11 THEN"
        " concat('x', cast(o_orderkey AS string)) WHEN o_orderkey > 0 AND o_orderkey % 89 <> 3 THEN"
        " concat('o', cast(o_orderkey div 2 AS string)) END AS parent_trace_id",
        "o_orderdate AS start_time",
        "o_orderdate + make_dt_interval(0, 0, 0, cast(o_custkey % 100 AS decimal(18,6))) AS end_time",
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("start_time"), F.min("l_quantity").alias("length")
    ).selectExpr(
        "concat('l', cast(l_orderkey AS string), '_', cast(l_linenumber AS string)) AS id",
        "CASE WHEN l_linenumber > 1 THEN concat('l', cast(l_orderkey AS string), '_', cast(l_linenumber - 1 AS string))"
        " ELSE concat('o', cast(l_orderkey AS string)) END AS parent_trace_id",
        "start_time", "start_time + make_dt_interval(0, 0, 0, cast(length AS decimal(18,6))) AS end_time",
    )
    return orders.unionByName(lines)
