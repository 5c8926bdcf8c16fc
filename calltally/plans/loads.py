"""Queries for cleansing, loads, file scans, stores and the dataset lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltally import schemas, values
from calltally.functions import numbers, pricing, text, times
from calltally.operators import cleaning, etl, evaluations, filters
from calltally.plans.inputs import (
    ANCHOR,
    battles,
    completions,
    evals,
    pairs,
    table,
    uploaded_text,
    uploads,
)
from calltally.plans.operations import DAILY_SQL, RAW_CTE, daily_report, raw_calls
from calltally.plans.registry import query
from calltally.plans.texts import bleu_parts, over_recursive, rouge_parts
from calltally.plans.traffic import END
from calltally.plans.twins import (
    BATTLES_CTE,
    PAIRS_CTE,
    PRICE_CTE,
    RANGE_CTE,
    UPLOADED_CTE,
    UPLOADS_CTE,
    draw,
    over,
    over_completions,
    over_evals,
    strip,
    words,
)
from calltally.session import scratch_path
from calltally.sources import files, tables

NUMBER = numbers.NUMBER


def number(cell: str, default: str) -> str:
    plain = strip(cell)
    return (
        f"CASE WHEN regexp_matches({plain}, '{NUMBER}') THEN coalesce(TRY_CAST({plain} AS DOUBLE),"
        f" {default}) ELSE {default} END"
    )


def whole(cell: str, default: str) -> str:
    return f"coalesce(TRY_CAST(trunc({number(cell, 'NULL::DOUBLE')}) AS INT), {default})"


def word_tokens(cell: str) -> str:
    return f"CAST(greatest(1, trunc(len({words(cell)}) * 1.3::DOUBLE)) AS INT)"


@query(
    "cl1_clamp",
    over_completions(
        """SELECT id, greatest(1, tokens_in) AS tokens_in, greatest(1, tokens_out) AS tokens_out,
  greatest(0.001::DOUBLE, latency_ms) AS latency_ms, greatest(0.0::DOUBLE, cost_usd) AS cost_usd FROM raw""",
        RAW_CTE,
    ),
)
def _(spark, folder):
    return cleaning.clamp_calls(raw_calls(spark, folder)).select(
        "id", "tokens_in", "tokens_out", "latency_ms", "cost_usd"
    )


@query(
    "cl2_drop_blank_pairs",
    over(f"SELECT _seq, prompt, response FROM uploaded WHERE length({strip('prompt')}) > 0", UPLOADED_CTE),
)
def _(spark, folder):
    return cleaning.drop_blank_pairs(uploaded_text(spark, folder)).select("_seq", "prompt", "response")


FILLED = f"""SELECT _seq, {strip('prompt')} AS prompt, {strip('response')} AS response,
  coalesce(nullif({strip('model')}, ''), 'uploaded') AS model,
  {whole('tokens_in', word_tokens('prompt'))} AS tokens_in,
  {whole('tokens_out', word_tokens('response'))} AS tokens_out,
  {number('latency_ms', '0.0::DOUBLE')} AS latency_ms, {number('cost_usd', '0.0::DOUBLE')} AS cost_usd,
  {number('quality_rating', 'NULL::DOUBLE')} AS quality_rating,
  nullif({strip('criteria')}, '') AS criteria
FROM uploaded WHERE length({strip('prompt')}) > 0"""


@query("cl3_cl4_filled_cells", over(FILLED, UPLOADED_CTE))
def _(spark, folder):
    rows = cleaning.drop_blank_pairs(uploaded_text(spark, folder))
    return cleaning.fill_upload_columns(rows)


@query("cl5_tokens_by_words", f"SELECT doc_id, {word_tokens('text')} AS tokens FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.tokens_by_words(F.col("text")).alias("tokens")
    )


@query(
    "cl6_tokens_by_chars",
    "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.tokens_by_chars(F.col("text")).alias("tokens")
    )


@query(
    "cl7_tokens_as_words",
    f"SELECT doc_id, CAST(greatest(1, len({words('text')})) AS INT) AS tokens FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.tokens_as_words(F.col("text")).alias("tokens")
    )


@query("cl8_cost", over_completions("SELECT id, model, cost_usd FROM completions"))
def _(spark, folder):
    calls = pricing.with_prices(
        completions(spark, folder).select("id", "model", "tokens_in", "tokens_out"),
        pricing.price_table(spark),
    )
    cost = F.round(
        F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out"), 8
    )
    return calls.select("id", "model", cost.alias("cost_usd"))


PARSED = """coalesce(TRY_CAST(regexp_replace(timestamp, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', '') AS TIMESTAMP),
    TRY_CAST(substr(timestamp, 1, 19) AS TIMESTAMP))"""


@query("cl9_wall_clock", over(f"SELECT seq, {PARSED} AS at FROM battles", BATTLES_CTE))
def _(spark, folder):
    return battles(spark, folder).select("seq", times.wall_clock(F.col("timestamp")).alias("at"))


DISTINCT_CTE = """named AS (
  SELECT * REPLACE (coalesce(conversation_id, 'lmsys_' || CAST(seq AS VARCHAR)) AS conversation_id)
  FROM battles),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq) = 1)"""
SECONDS = draw("conversation_id", "time", 604801)
BACKFILLED = f"coalesce({PARSED}, TIMESTAMP '{ANCHOR}' - to_seconds({SECONDS}))"
TOKENS_IN = f"coalesce(tokens_in, CAST(50 + {draw('conversation_id', 'tokens_in', 451)} AS INT))"
TOKENS_OUT = f"coalesce(tokens_out, CAST(20 + {draw('conversation_id', 'tokens_out', 281)} AS INT))"
LOADED_CTE = f"""loaded AS (
  SELECT seq, conversation_id, model_a, model_b, winner, language, {BACKFILLED} AS timestamp,
    {TOKENS_IN} AS tokens_in, {TOKENS_OUT} AS tokens_out,
    coalesce(latency_ms, 500.0::DOUBLE) AS latency_ms, cost_usd
  FROM firsts),
costed AS (
  SELECT l.* REPLACE (coalesce(cost_usd, round(tokens_in / 1000 * coalesce(ri, 0.001::DOUBLE)
    + tokens_out / 1000 * coalesce(ro, 0.002::DOUBLE), 8)) AS cost_usd)
  FROM loaded l LEFT JOIN prices p ON p.model = lower(l.model_a))"""
BATTLE_PARTS = (PRICE_CTE, BATTLES_CTE, DISTINCT_CTE, LOADED_CTE)


@query(
    "cl10_backfilled_time",
    over(f"SELECT seq, {BACKFILLED} AS at FROM firsts", BATTLES_CTE, DISTINCT_CTE),
)
def _(spark, folder):
    firsts = etl.distinct_battles(battles(spark, folder))
    return firsts.select(
        "seq",
        cleaning.backfilled_time(
            F.col("timestamp"), F.col("conversation_id"), F.lit(ANCHOR).cast("timestamp_ntz")
        ).alias("at"),
    )


UNIT = draw("conversation_id", "latency", 2**32) + " / 4294967296.0::DOUBLE"


@query(
    "cl11_imputed_latency",
    over(
        f"""SELECT f.seq, round(coalesce(lo, 500) + {UNIT} * (coalesce(hi, 2000) - coalesce(lo, 500)), 1)
  AS latency_ms FROM firsts f LEFT JOIN ranges r ON r.model = lower(f.model_a)""",
        RANGE_CTE,
        BATTLES_CTE,
        DISTINCT_CTE,
    ),
)
def _(spark, folder):
    firsts = etl.distinct_battles(battles(spark, folder))
    return firsts.select(
        "seq",
        cleaning.imputed_latency(F.col("model_a"), F.col("conversation_id")).alias("latency_ms"),
    )


@query(
    "cl12_imputed_tokens",
    over("SELECT seq, tokens_in, tokens_out, latency_ms, cost_usd FROM costed", *BATTLE_PARTS),
)
def _(spark, folder):
    key = F.col("conversation_id")
    filled = etl.distinct_battles(battles(spark, folder)).select(
        "seq",
        "model_a",
        cleaning.imputed_tokens_in(F.col("tokens_in"), key).alias("tokens_in"),
        cleaning.imputed_tokens_out(F.col("tokens_out"), key).alias("tokens_out"),
        F.coalesce("latency_ms", F.lit(500.0)).alias("latency_ms"),
        "cost_usd",
    )
    cost = pricing.cost(F.col("tokens_in"), F.col("tokens_out"), F.col("model_a"))
    return filled.withColumn("cost_usd", F.coalesce("cost_usd", cost)).drop("model_a")


@query(
    "cl13_first_per_conversation",
    over("SELECT seq, conversation_id, winner FROM firsts", BATTLES_CTE, DISTINCT_CTE),
)
def _(spark, folder):
    return etl.distinct_battles(battles(spark, folder)).select("seq", "conversation_id", "winner")


RATING = number("quality_rating", "NULL::DOUBLE")


@query(
    "cl14_upload_rating",
    over(
        f"""SELECT _seq, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN r > 1 THEN r / 10 ELSE r END)) AS score
FROM (SELECT _seq, {RATING} AS r FROM uploaded) WHERE r IS NOT NULL""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    rating = numbers.parse_float(F.col("quality_rating"), F.lit(None))
    rated = uploaded_text(spark, folder).select(
        "_seq", cleaning.upload_rating(rating).alias("score"), rating.alias("rating")
    )
    return rated.where(F.col("rating").isNotNull()).drop("rating")


@query(
    "cl15_benchmark_rating",
    over(f"SELECT _seq, coalesce({RATING}, 5.0::DOUBLE) / 10 AS score FROM uploaded", UPLOADED_CTE),
)
def _(spark, folder):
    rating = numbers.parse_float(F.col("quality_rating"), F.lit(None))
    return uploaded_text(spark, folder).select(
        "_seq", cleaning.benchmark_rating(rating).alias("score")
    )


@query(
    "cl16_content_key",
    "SELECT doc_id, sha256(lang || '||' || text || '||') AS content_key FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        text.content_key(F.col("lang"), F.col("text"), F.lit(None).cast("string")).alias("content_key"),
    )


@query(
    "cl18_flat_messages",
    over(
        """SELECT id, CASE WHEN prev_role = 'system' THEN prev_text || ' ' || prompt ELSE prompt END AS prompt,
  response FROM pairs""",
        PAIRS_CTE,
    ),
)
def _(spark, folder):
    called = pairs(spark, folder)
    system = F.when(
        F.col("prev_role") == "system",
        F.struct(F.col("prev_role").alias("role"), F.col("prev_text").alias("content")),
    )
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    messages = called.select(
        "id",
        F.array_compact(F.array(system, user)).alias("messages"),
        F.array(F.struct(F.col("response").alias("text"))).alias("blocks"),
    )
    return cleaning.flatten_messages(messages, "messages", "blocks").select("id", "prompt", "response")


def _user_sql(key: str, users: int = values.ARENA_USERS) -> str:
    return f"'user_' || lpad(CAST(1 + {draw(key, 'user', users)} AS VARCHAR), 3, '0')"


SIDES_SQL = f"""SELECT seq * 2 AS id, timestamp,
  '[' || language || '] Arena battle: ' || model_a || ' vs ' || model_b AS prompt,
  'Winner: ' || winner AS response, model_a AS model, tokens_in, tokens_out, latency_ms, cost_usd,
  {_user_sql("conversation_id")} AS user_id, conversation_id,
  CASE winner WHEN 'model_a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS score FROM costed
UNION ALL SELECT seq * 2 + 1, timestamp,
  '[' || language || '] Arena battle: ' || model_a || ' vs ' || model_b, 'Winner: ' || winner, model_b,
  tokens_in, tokens_out, latency_ms, cost_usd * 0.8::DOUBLE,
  {_user_sql("(conversation_id || '_b')")}, conversation_id || '_b',
  CASE winner WHEN 'model_b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END FROM costed"""
SIDES = over(SIDES_SQL, *BATTLE_PARTS)


@query("etl1_etl2_battle_sides", SIDES)
def _(spark, folder):
    return etl.battle_sides(battles(spark, folder), ANCHOR).drop("source")


def in_words(column: str) -> str:
    return f"CAST(greatest(1, len({words(column)})) AS INT)"


def benchmark_source(spark, folder):
    """Pairs as rows of a benchmark file."""
    cells = uploaded_text(spark, folder)
    return cells.select(
        F.col("_seq").alias("seq"),
        "prompt",
        "response",
        F.when(F.col("quality_rating").rlike("^[0-9]+$"), F.col("quality_rating")).alias("quality_rating"),
        F.when(F.col("criteria") != "", F.col("criteria")).alias("criteria"),
        F.when(F.col("_seq") % 3 != 0, "carol").alias("human_rater"),
    )


HOURS = draw("CAST(_seq AS VARCHAR)", "hours", 73)


@query(
    "etl3_benchmark_completions",
    over(
        f"""SELECT _seq AS id, TIMESTAMP '{ANCHOR}' - to_hours({HOURS}) AS timestamp, prompt, response,
  'eval-dataset' AS model, {in_words('prompt')} AS tokens_in, {in_words('response')} AS tokens_out,
  0.0::DOUBLE AS latency_ms, 0.0::DOUBLE AS cost_usd, 'benchmark' AS user_id,
  CAST(NULL AS VARCHAR) AS conversation_id, 'evals_benchmark' AS source FROM uploaded""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    return etl.completions_of(etl.benchmark_rows(benchmark_source(spark, folder), ANCHOR))


SCORED_FILE = "file AS (SELECT _seq AS id, prompt, response FROM uploaded)"


@query(
    "etl3_benchmark_scores",
    over_recursive(
        """SELECT id AS completion_id, 'bleu' AS eval_type, bleu AS score FROM bleu_scores
UNION ALL SELECT id, 'rouge', "rougeL" FROM rouge_scores
UNION ALL SELECT _seq, 'human', CASE WHEN regexp_matches(quality_rating, '^[0-9]+$')
    THEN CAST(quality_rating AS DOUBLE) ELSE 5.0 END / 10 FROM uploaded""",
        UPLOADED_CTE,
        SCORED_FILE,
        bleu_parts("file"),
        rouge_parts("file", stemming=True),
    ),
)
def _(spark, folder):
    rows = etl.benchmark_rows(benchmark_source(spark, folder), ANCHOR)
    scores = etl.benchmark_evals(rows, ANCHOR)
    return scores.select("completion_id", "eval_type", F.round("score", 6).alias("score"))


@query(
    "etl3_benchmark_scores_unstemmed",
    over_recursive(
        """SELECT id AS completion_id, 'bleu' AS eval_type, bleu AS score FROM bleu_scores
UNION ALL SELECT id, 'rouge', "rougeL" FROM rouge_scores
UNION ALL SELECT _seq, 'human', CASE WHEN regexp_matches(quality_rating, '^[0-9]+$')
    THEN CAST(quality_rating AS DOUBLE) ELSE 5.0 END / 10 FROM uploaded""",
        UPLOADED_CTE,
        SCORED_FILE,
        bleu_parts("file"),
        rouge_parts("file"),
    ),
)
def _(spark, folder):
    rows = etl.benchmark_rows(benchmark_source(spark, folder), ANCHOR)
    scores = etl.benchmark_evals(rows, ANCHOR, stemming=False)
    return scores.select("completion_id", "eval_type", F.round("score", 6).alias("score"))


@query(
    "etl3_benchmark_human_scores",
    over(
        """SELECT _seq AS completion_id, CASE WHEN regexp_matches(quality_rating, '^[0-9]+$')
    THEN CAST(quality_rating AS DOUBLE) ELSE 5.0 END / 10 AS score,
  coalesce(nullif(criteria, ''), 'helpful, accurate, relevant') AS criteria,
  'Rated by: ' || CASE WHEN _seq % 3 <> 0 THEN 'carol' ELSE '?' END AS explanation FROM uploaded""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    rows = etl.benchmark_rows(benchmark_source(spark, folder), ANCHOR)
    scores = etl.benchmark_evals(rows, ANCHOR, stemming=False)
    return scores.where(F.col("eval_type") == "human").select(
        "completion_id", "score", "criteria", "explanation"
    )


@query(
    "etl4_upload_completions",
    over(
        f"""SELECT _seq AS id, TIMESTAMP '{ANCHOR}' AS timestamp, prompt, response, model, tokens_in, tokens_out,
  latency_ms, cost_usd, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS conversation_id,
  'upload_demo' AS source FROM ({FILLED})""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    return etl.completions_of(
        etl.upload_rows(uploaded_text(spark, folder), "upload_demo", ANCHOR)
    )


@query(
    "etl4_upload_scores",
    over_recursive(
        """SELECT id AS completion_id, 'bleu' AS eval_type, bleu AS score, criteria
  FROM bleu_scores JOIN file USING (id)
UNION ALL SELECT id, 'rouge', round((rouge1 + "rougeL") / 2, 6), criteria
  FROM rouge_scores JOIN file USING (id)
UNION ALL SELECT id, 'human', least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    CASE WHEN rating > 1 THEN rating / 10 ELSE rating END)), NULL FROM file WHERE rating IS NOT NULL""",
        UPLOADED_CTE,
        f"""file AS (SELECT _seq AS id, prompt, response, criteria, quality_rating AS rating
  FROM ({FILLED}))""",
        bleu_parts("file"),
        rouge_parts("file", stemming=True),
    ),
)
def _(spark, folder):
    rows = etl.upload_rows(uploaded_text(spark, folder), "upload_demo", ANCHOR)
    scores = etl.upload_evals(rows, ANCHOR)
    return scores.select(
        "completion_id", "eval_type", F.round("score", 6).alias("score"), "criteria"
    )


@query(
    "etl4_upload_scores_unstemmed",
    over_recursive(
        """SELECT id AS completion_id, 'bleu' AS eval_type, bleu AS score, criteria
  FROM bleu_scores JOIN file USING (id)
UNION ALL SELECT id, 'rouge', round((rouge1 + "rougeL") / 2, 6), criteria
  FROM rouge_scores JOIN file USING (id)
UNION ALL SELECT id, 'human', least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    CASE WHEN rating > 1 THEN rating / 10 ELSE rating END)), NULL FROM file WHERE rating IS NOT NULL""",
        UPLOADED_CTE,
        f"""file AS (SELECT _seq AS id, prompt, response, criteria, quality_rating AS rating
  FROM ({FILLED}))""",
        bleu_parts("file"),
        rouge_parts("file"),
    ),
)
def _(spark, folder):
    rows = etl.upload_rows(uploaded_text(spark, folder), "upload_demo", ANCHOR)
    scores = etl.upload_evals(rows, ANCHOR, stemming=False)
    return scores.select(
        "completion_id", "eval_type", F.round("score", 6).alias("score"), "criteria"
    )


MODEL_DRAW = f"CASE WHEN {draw('conversation_id', 'side', 2)} = 0 THEN model_a ELSE model_b END"


@query(
    "etl5_single_model_calls",
    over(
        f"""SELECT c.seq AS id, c.timestamp, '[Conv ' || conversation_id || '] User prompt' AS prompt,
  '[Model ' || c.model || '] Response to conversation ' || conversation_id AS response, c.model,
  tokens_in, tokens_out,
  coalesce(latency_ms, round(coalesce(lo, 500) + {UNIT} * (coalesce(hi, 2000) - coalesce(lo, 500)), 1)) AS latency_ms,
  coalesce(cost_usd, round(tokens_in / 1000 * coalesce(ri, 0.001::DOUBLE)
    + tokens_out / 1000 * coalesce(ro, 0.002::DOUBLE), 8)) AS cost_usd,
  {_user_sql("conversation_id", values.SINGLE_MODEL_USERS)} AS user_id, conversation_id, 'lmsys' AS source
FROM chosen c LEFT JOIN prices p ON p.model = lower(c.model)
LEFT JOIN ranges r ON r.model = lower(c.model)""",
        PRICE_CTE,
        RANGE_CTE,
        BATTLES_CTE,
        DISTINCT_CTE.replace("'lmsys_'", "'conv_'"),
        f"""chosen AS (SELECT seq, conversation_id, {MODEL_DRAW} AS model, {TOKENS_IN} AS tokens_in,
    {TOKENS_OUT} AS tokens_out, latency_ms, cost_usd, {BACKFILLED} AS timestamp FROM firsts)""",
    ),
)
def _(spark, folder):
    return etl.single_model_calls(battles(spark, folder), ANCHOR)


TIER_DRAW = draw("(prompt || '|' || answer)", "rating", "(high - low + 1)")
RATER_DRAW = draw("(prompt || '|' || answer)", "rater", 5)


@query(
    "etl6_rating_tiers",
    over(
        f"""SELECT prompt, {strip('answer')} AS response, CAST(low + {TIER_DRAW} AS INT) AS quality_rating,
  'detail' AS criteria, ['alice', 'bob', 'carol', 'david', 'eve'][{RATER_DRAW} + 1] AS human_rater
FROM (SELECT prompt, response || '!' AS answer, 8 AS low, 10 AS high FROM pairs
  UNION ALL SELECT prompt, ' ' || response, 4, 7 FROM pairs
  UNION ALL SELECT prompt, 'no', 1, 3 FROM pairs UNION ALL SELECT prompt, 'bad ', 1, 3 FROM pairs)""",
        PAIRS_CTE,
    ),
)
def _(spark, folder):
    prompts = pairs(spark, folder).select(
        "prompt",
        F.lit("detail").alias("criteria"),
        F.array(F.concat("response", F.lit("!"))).alias("excellent"),
        F.array(F.concat(F.lit(" "), "response")).alias("mediocre"),
        F.array(F.lit("no"), F.lit("bad ")).alias("poor"),
    )
    return etl.expand_rating_tiers(prompts)


CELLS = "prompt, response, model, tokens_in, tokens_out, latency_ms, cost_usd, quality_rating, criteria"


@query("src1_upload_csv", over(f"SELECT {CELLS} FROM uploaded", UPLOADED_CTE))
def _(spark, folder):
    path = scratch_path(spark, "upload_csv")
    cells = uploaded_text(spark, folder).drop("_seq")
    files.write_csv(cells.withColumnsRenamed({"prompt": " Prompt ", "response": "RESPONSE"}), path)
    return files.read_upload_csv(spark, path).drop("_seq")


BATTLE_CELLS = (
    "conversation_id, model_a, model_b, winner, language, timestamp, tokens_in, tokens_out,"
    " latency_ms, cost_usd"
)


@query("src2_battles_csv", over(f"SELECT {BATTLE_CELLS} FROM battles", BATTLES_CTE))
def _(spark, folder):
    path = scratch_path(spark, "battles_csv")
    files.write_csv(battles(spark, folder).drop("seq"), path)
    return files.read_battles_csv(spark, path).drop("seq")


@query(
    "src3_snk4_benchmark_csv",
    over(
        """SELECT prompt, response, CASE WHEN regexp_matches(quality_rating, '^[0-9]+$')
    THEN quality_rating END AS quality_rating, nullif(criteria, '') AS criteria,
  CASE WHEN _seq % 3 <> 0 THEN 'carol' END AS human_rater FROM uploaded""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "benchmark_csv")
    files.write_csv(benchmark_source(spark, folder).drop("seq"), path)
    return files.read_benchmark_csv(spark, path).drop("seq")


@query(
    "src4_replayed_calls",
    over_completions(
        """SELECT model, CAST(tokens_in AS DOUBLE) AS tokens_in, CAST(tokens_out AS DOUBLE) AS tokens_out,
  latency_ms, cost_usd, user_id, conversation_id FROM completions WHERE id % 101 <> 0
UNION ALL SELECT model, tokens_in, tokens_out, latency_ms, cost_usd, user_id, conversation_id || '_again'
  FROM completions WHERE id % 101 <> 0 AND id % 3 = 0"""
    ),
)
def _(spark, folder):
    calls = completions(spark, folder)

    def payload(conversation):
        return F.struct(
            "prompt", "response", "model", "tokens_in", "tokens_out", "latency_ms", "cost_usd", "user_id",
            conversation.alias("conversation_id"),
        )

    once = payload(F.col("conversation_id"))
    again = payload(F.concat("conversation_id", F.lit("_again")))
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    line = (
        F.when(F.col("id") % 101 == 0, F.lit("{broken"))
        .when(F.col("id") % 3 == 0, files.undelivered_line("/api/v1/logs/batch", F.array(once, again), at))
        .otherwise(files.undelivered_line("/api/v1/logs", once, at))
    )
    path = scratch_path(spark, "undelivered")
    calls.select(line.alias("value")).write.text(path)
    return files.replay_undelivered(spark, path).select(
        "model", "tokens_in", "tokens_out", "latency_ms", "cost_usd", "user_id", "conversation_id"
    )


STORED = "id, timestamp, prompt, response, conversation_id, model, tokens_in, tokens_out, latency_ms, cost_usd, user_id, source"


@query("snk1_stored_completions", over_completions(f"SELECT {STORED} FROM completions"))
def _(spark, folder):
    path = scratch_path(spark, "completions")
    rows = completions(spark, folder).select(*etl.COMPLETION_COLUMNS)
    for _ in range(2):
        tables.append_completions(rows, path, "first")
    stored = tables.read_table(spark, path, schemas.COMPLETIONS)
    return stored.select(*[c.strip() for c in STORED.split(",")])


@query(
    "snk2_stored_evals",
    over_evals("SELECT id, completion_id, eval_type, score, created_at, source FROM evals"),
)
def _(spark, folder):
    path = scratch_path(spark, "evals")
    tables.append_evals(evals(spark, folder), path, "all")
    return tables.read_table(spark, path, schemas.EVALS).select(
        "id", "completion_id", "eval_type", "score", "created_at", "source"
    )


@query(
    "snk3_loaded_battles",
    over(f"SELECT id, conversation_id, model, cost_usd, score FROM ({SIDES_SQL})", *BATTLE_PARTS),
)
def _(spark, folder):
    root = scratch_path(spark, "arena")
    tables.load_battles(battles(spark, folder), root, ANCHOR)
    stored = tables.read_table(spark, f"{root}/completions", schemas.COMPLETIONS)
    scores = tables.read_table(spark, f"{root}/evals", schemas.EVALS)
    return stored.join(
        scores.select(F.col("completion_id").alias("id"), "score"), "id"
    ).select("id", "conversation_id", "model", "cost_usd", "score")


@query(
    "snk5_registry_row",
    over(
        f"""SELECT CAST('0x' || substr(sha256('upload_demo'), 1, 15) AS BIGINT) AS id,
  'upload_demo' AS source_id, 'demo.csv' AS filename, count(*) AS row_count,
  true AS has_quality_rating, true AS has_model_column, TIMESTAMP '{ANCHOR}' AS created_at FROM ({FILLED})""",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    cells = uploaded_text(spark, folder)
    rows = etl.upload_rows(cells, "upload_demo", ANCHOR)
    return tables.registry_row(rows, "upload_demo", "demo.csv", cells.columns, ANCHOR)


@query(
    "snk6_without_dataset",
    over_evals(
        """SELECT 'uploads' AS kind, id FROM uploads WHERE id <> 1
UNION ALL SELECT 'completions', id FROM completions WHERE source <> 'upload_a'
UNION ALL SELECT 'evals', id FROM evals
  WHERE completion_id NOT IN (SELECT id FROM completions WHERE source = 'upload_a')""",
        UPLOADS_CTE,
    ),
)
def _(spark, folder):
    kept = tables.without_dataset(
        uploads(spark, folder), completions(spark, folder), evals(spark, folder), 1
    )
    names = ("uploads", "completions", "evals")
    root = tables.write_version(dict(zip(names, kept)), scratch_path(spark, "versions"), "v2")
    result = None
    for name in names:
        part = spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("kind"), "id")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "snk7_reloaded",
    over(
        f"""SELECT 'lmsys' AS source, id, timestamp, model, score AS main_score FROM ({SIDES_SQL})
UNION ALL SELECT 'evals_benchmark', (SELECT max(id) + 1 FROM ({SIDES_SQL})) + _seq,
  TIMESTAMP '{ANCHOR}' - to_hours({HOURS}), 'eval-dataset', CASE WHEN regexp_matches(quality_rating, '^[0-9]+$')
    THEN CAST(quality_rating AS DOUBLE) ELSE 5.0 END / 10 FROM uploaded""",
        *BATTLE_PARTS,
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    root = scratch_path(spark, "reload")
    tables.reload_all(battles(spark, folder), benchmark_source(spark, folder), root, ANCHOR)
    stored = tables.read_table(spark, f"{root}/completions", schemas.COMPLETIONS)
    scores = tables.read_table(spark, f"{root}/evals", schemas.EVALS)
    main = scores.where(F.col("eval_type").isin("human", values.PREFERENCE)).select(
        F.col("completion_id").alias("id"), F.col("score").alias("main_score")
    )
    return stored.join(main, "id", "left").select("source", "id", "timestamp", "model", "main_score")


@query("snk8_refreshed_view", over_completions(DAILY_SQL))
def _(spark, folder):
    """A view that first lacks late rows and is then refreshed for the days they touch."""
    path = scratch_path(spark, "daily")
    calls = completions(spark, folder)
    late = F.to_date("timestamp").isin("2024-01-05", "2024-01-06") & (F.col("id") % 2 == 0)
    tables.refresh_daily(calls.where(~late), path)
    tables.refresh_daily(calls, path, ["2024-01-05", "2024-01-06"])
    return daily_report(spark.read.parquet(path))


@query(
    "snk9_recorded_evals",
    over_evals(
        """SELECT id, eval_type, round(score * 1.25::DOUBLE - 0.0625::DOUBLE, 9) AS score FROM evals
WHERE score * 1.25::DOUBLE - 0.0625::DOUBLE BETWEEN 0 AND 1"""
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "recorded")
    sent = evals(spark, folder).withColumn("score", F.col("score") * 1.25 - 0.0625)
    tables.record_evals(sent, path, "external")
    return tables.read_table(spark, path, schemas.EVALS).select(
        "id", "eval_type", F.round("score", 9).alias("score")
    )


@query(
    "snk10_retired",
    over_completions(
        """SELECT CASE WHEN timestamp < TIMESTAMP '2024-01-10' THEN 'archive' ELSE 'kept' END AS part, id
FROM completions"""
    ),
)
def _(spark, folder):
    root = scratch_path(spark, "retire")
    tables.retire(completions(spark, folder), "2024-01-10", f"{root}/archive", f"{root}/kept")
    old, kept = spark.read.parquet(f"{root}/archive"), spark.read.parquet(f"{root}/kept")
    return old.select(F.lit("archive").alias("part"), "id").unionByName(
        kept.select(F.lit("kept").alias("part"), "id")
    )


SLICE = f"model = 'gpt-4' AND source = 'lmsys' AND timestamp >= TIMESTAMP '{END}'"


def _slice(spark, folder):
    scope = filters.scoped(completions(spark, folder), start=END, source=values.ARENA, model="gpt-4")
    return scope.select("id", "model", "tokens_in", "prompt", "latency_ms")


@query(
    "snk11_exported_csv",
    over_completions(f"SELECT id, model, tokens_in, prompt, latency_ms FROM completions WHERE {SLICE}"),
)
def _(spark, folder):
    path = scratch_path(spark, "export_csv")
    rows = _slice(spark, folder)
    files.write_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query(
    "snk11_exported_json",
    over_completions(f"SELECT id, model, tokens_in, prompt, latency_ms FROM completions WHERE {SLICE}"),
)
def _(spark, folder):
    path = scratch_path(spark, "export_json")
    rows = _slice(spark, folder)
    files.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "p4_upload_features",
    over(
        "SELECT count(*) AS rows, true AS has_quality_rating, true AS has_model_column FROM uploaded",
        UPLOADED_CTE,
    ),
)
def _(spark, folder):
    cells = uploaded_text(spark, folder)
    flags = files.upload_features(cells.columns)
    return cells.agg(
        F.count(F.lit(1)).alias("rows"), *[F.lit(flag).alias(name) for name, flag in flags.items()]
    )


@query(
    "ag18_arena_wins",
    over(
        """SELECT model_a, round(avg(latency_ms), 2) AS avg_latency, round(sum(cost_usd), 4) AS total_cost,
  count(*) FILTER (WHERE winner = 'model_a') AS wins, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (WHERE winner = 'model_a') / count(*), 1) AS win_rate
FROM battles GROUP BY model_a""",
        BATTLES_CTE,
    ),
)
def _(spark, folder):
    return evaluations.battle_report(battles(spark, folder))
