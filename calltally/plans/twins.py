"""SQL pieces shared by the twins: the derived tables as CTEs and a few expressions."""

from __future__ import annotations

from calltally import values

# The whitespace class in the twin's regex dialect.
SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PRICES = ", ".join(f"('{m}', {i!r}, {o!r})" for m, (i, o) in values.MODEL_PRICES.items())
RANGES = ", ".join(f"('{m}', {lo}.0, {hi}.0)" for m, (lo, hi) in values.LATENCY_RANGES.items())




PRICE_CTE = (
    "prices AS (SELECT model, CAST(ri AS DOUBLE) AS ri, CAST(ro AS DOUBLE) AS ro"
    f" FROM (VALUES {PRICES}) AS t(model, ri, ro))"
)
RANGE_CTE = (
    "ranges AS (SELECT model, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi"
    f" FROM (VALUES {RANGES}) AS t(model, lo, hi))"
)

COMPLETIONS_CTE = f"""{PRICE_CTE},
calls AS (
  SELECT event_id AS id, ts AS timestamp,
    'call ' || CAST(event_id AS VARCHAR) || repeat(' and more', event_id % 29) AS prompt,
    'answer ' || props AS response,
    CASE event_type WHEN 'view' THEN 'gpt-4' WHEN 'click' THEN 'gpt-3.5-turbo'
      WHEN 'signup' THEN 'claude-3-opus' WHEN 'purchase' THEN 'mistral-large'
      ELSE 'unlisted-model' END AS model,
    CAST(json_extract_string(props, '$.k') AS INT) + 1 AS tokens_in,
    CAST(event_id % 97 AS INT) AS tokens_out,
    value * 10 + (event_id % 1009) / 1013 AS latency_ms,
    CASE WHEN event_id % 53 <> 0 THEN 'user_' || CAST(user_id AS VARCHAR) END AS user_id,
    'conv_' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR) AS conversation_id,
    CASE WHEN event_id % 10 = 0 THEN 'evals_benchmark' WHEN event_id % 10 = 1 THEN 'upload_a'
      ELSE 'lmsys' END AS source,
    event_id % 97 > 0 AS success,
    CASE WHEN event_id % 97 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'timeout'
      WHEN 1 THEN 'rate_limit' ELSE 'server_error' END END AS error_code,
    (event_id % 26) / 10 AS temperature
  FROM events
),
completions AS (
  SELECT c.*, round(tokens_in / 1000 * coalesce(ri, 0.001::DOUBLE)
      + tokens_out / 1000 * coalesce(ro, 0.002::DOUBLE), 8) AS cost_usd
  FROM calls c LEFT JOIN prices p ON p.model = lower(c.model)
)"""

EVALS_CTE = """evals AS (
  SELECT event_id * 4 AS id, event_id AS completion_id, 'human_preference' AS eval_type,
    (event_id % 3) / 2 AS score, ts + to_minutes(event_id % 90) AS created_at,
    'human_preference' AS source FROM events WHERE event_id % 10 > 1
  UNION ALL
  SELECT event_id * 4 + 1, event_id, 'human', (event_id % 129) / 128,
    ts + to_minutes(event_id % 90), 'benchmark' FROM events WHERE event_id % 10 <= 1
  UNION ALL
  SELECT event_id * 4 + 2, event_id, 'llm_judge', (event_id * 7 % 129) / 128,
    ts + to_minutes(event_id % 90), 'benchmark' FROM events
    WHERE event_id % 10 <= 1 AND event_id % 7 <> 3
  UNION ALL
  SELECT event_id * 4 + 3, event_id + 10000000000, 'rules', (event_id % 5) / 4,
    ts + to_minutes(event_id % 90), 'computed' FROM events WHERE event_id % 50 = 49
)"""

SCORED_CTE = """scored AS (
  SELECT e.eval_type, e.score, e.completion_id, c.model, c.timestamp, c.latency_ms, c.cost_usd,
    c.source
  FROM evals e JOIN completions c ON e.completion_id = c.id
)"""

UPLOADS_CTE = """uploads AS (
  SELECT CAST(u.id AS BIGINT) AS id, u.source_id, u.filename,
    CAST(coalesce(n.row_count, 0) AS BIGINT) AS row_count, u.has_quality_rating,
    u.has_model_column, CAST(u.created_at AS TIMESTAMP) AS created_at
  FROM (VALUES (1, 'upload_a', 'a.csv', true, true, '2024-02-01 10:00:00'),
    (2, 'evals_benchmark', 'bench.csv', true, false, '2024-02-02 10:00:00'),
    (3, 'upload_b', 'b.csv', false, false, '2024-02-03 10:00:00'))
    AS u(id, source_id, filename, has_quality_rating, has_model_column, created_at)
  LEFT JOIN (SELECT source, count(*) AS row_count FROM completions GROUP BY source) n
    ON n.source = u.source_id
)"""

BATTLES_CTE = """battles AS (
  SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 13 <> 0
      THEN 'lmsys_' || CAST(o_orderkey - o_orderkey % 3 AS VARCHAR) END AS conversation_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'gpt-4' WHEN '2-HIGH' THEN 'claude-3-opus'
      WHEN '3-MEDIUM' THEN 'gpt-3.5-turbo' WHEN '4-NOT SPECIFIED' THEN 'gemini-pro'
      ELSE 'Unlisted-Model' END AS model_a,
    CASE o_custkey % 4 WHEN 0 THEN 'llama-2-70b' WHEN 1 THEN 'palm-2' WHEN 2 THEN 'gpt-4-turbo'
      ELSE 'mistral-large' END AS model_b,
    CASE WHEN o_custkey % 11 = 0 THEN 'both_bad' WHEN o_orderstatus = 'F' THEN 'model_a'
      WHEN o_orderstatus = 'O' THEN 'model_b' ELSE 'tie' END AS winner,
    CASE o_orderkey % 5 WHEN 0 THEN 'Klingon' WHEN 1 THEN 'German' WHEN 2 THEN 'French'
      ELSE 'English' END AS language,
    CASE WHEN o_orderkey % 17 <> 0 THEN strftime(TIMESTAMP '2024-01-01'
      + to_days(CAST(o_orderkey % 30 AS INT)) + to_seconds(o_custkey * 7 % 86400), '%Y-%m-%dT%H:%M:%S')
      || CASE o_orderkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN ''
      ELSE '.250000+05:30' END ELSE 'soon' END AS timestamp,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 400 + 20 AS INT) END AS tokens_in,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_custkey % 250 + 10 AS INT) END AS tokens_out,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey % 900 + 100 AS DOUBLE) END AS latency_ms,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 10000000 END AS cost_usd
  FROM orders
)"""

PAIRS_CTE = """linked AS (
  SELECT conv_id, turn, role, text,
    lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text,
    lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT conv_id * 1000000 + turn AS id, conv_id, turn, prev_role, prev_text, text AS prompt,
    next_text AS response
  FROM linked WHERE role = 'user' AND next_role = 'assistant'
)"""

UPLOADED_CTE = f"""{PAIRS_CTE},
uploaded AS (
  SELECT id AS _seq,
    CASE WHEN conv_id % 9 = 0 THEN ' ' || chr(9) || ' ' ELSE prompt END AS prompt,
    '  ' || response || ' ' AS response,
    CASE WHEN id % 7 = 0 THEN '  ' WHEN id % 7 < 4 THEN 'gpt-4' ELSE ' claude-3-opus ' END AS model,
    CASE id % 7 WHEN 1 THEN '12.7' WHEN 2 THEN 'oops' WHEN 3 THEN '' ELSE '80' END AS tokens_in,
    CASE id % 7 WHEN 4 THEN '1e2' WHEN 5 THEN 'nan' ELSE ' 33 ' END AS tokens_out,
    CASE id % 7 WHEN 6 THEN 'x' ELSE '120.5' END AS latency_ms,
    CASE id % 7 WHEN 5 THEN 'inf' ELSE '0.002' END AS cost_usd,
    CASE id % 7 WHEN 0 THEN '8' WHEN 1 THEN '1' WHEN 2 THEN '0.4' WHEN 3 THEN 'not_a_number'
      WHEN 4 THEN '-3' WHEN 5 THEN '12' ELSE '' END AS quality_rating,
    CASE WHEN id % 7 < 3 THEN ' clarity ' ELSE '' END AS criteria
  FROM pairs
)"""

TRACES_CTE = """traces AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_trace_id,
    'request' AS trace_type, o_orderpriority AS span_name, o_orderdate AS start_time,
    o_orderdate + to_seconds(o_custkey % 100) AS end_time,
    CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status,
    '{"status":"' || o_orderstatus || '","customer":' || CAST(o_custkey AS VARCHAR) || '}'
      AS trace_data
  FROM orders
  UNION ALL
  SELECT 'l' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_'
      || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR),
    'o' || CAST(l_orderkey AS VARCHAR), 'span', l_returnflag || l_linestatus, l_shipdate,
    l_shipdate + to_seconds(l_quantity - CASE WHEN l_partkey % 50 = 0 THEN 60 ELSE 0 END),
    CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END,
    '{"part":' || CAST(l_partkey AS VARCHAR) || '}'
  FROM lineitem
),
timed AS (
  SELECT *, CAST(date_diff('microsecond', start_time, end_time) AS DOUBLE) / 1000.0::DOUBLE
    AS duration_ms FROM traces
)"""


def over_completions(body: str, *more: str) -> str:
    return "WITH " + ",\n".join((COMPLETIONS_CTE, *more)) + "\n" + body


def over_evals(body: str, *more: str) -> str:
    return over_completions(body, EVALS_CTE, *more)


def over_scored(body: str, *more: str) -> str:
    return over_evals(body, SCORED_CTE, *more)


def over(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def usd_total(column: str) -> str:
    return f"coalesce(sum(CAST(round({column}, 8) AS DECIMAL(18, 8))), 0)"


def usd(total: str, digits: int = 6) -> str:
    return f"CAST(round({total}, {digits}) AS DOUBLE)"


def usd_mean(column: str, rows: str = "count(*)") -> str:
    """Mean money to 6 digits in whole numbers of 1e-8, half up."""
    units = f"sum(CAST(round({column} * 100000000) AS BIGINT))"
    return f"CAST(({units} + 50 * {rows}) // (100 * {rows}) AS DOUBLE) / 1000000.0::DOUBLE"


def mean(column: str, digits: int) -> str:
    return f"round(coalesce(avg({column}), 0), {digits})"


def quantile(column: str, share: float) -> str:
    return f"round(coalesce(quantile_cont({column}, {share}), 0), 2)"


def percent(part: str, whole: str, empty: str = "100.0", digits: int = 2) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN {empty} ELSE {part} / {whole} * 100 END, {digits})"


def draw(key: str, salt: str, choices) -> str:
    return f"(CAST('0x' || substr(md5({key} || '|{salt}'), 1, 8) AS BIGINT) % {choices})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


OK = "count(*) FILTER (WHERE tokens_out > 0)"
