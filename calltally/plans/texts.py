"""Queries for text scores, rules and judge preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltally import values
from calltally.functions.text import folded_words
from calltally.operators import judge, rules, text_scores
from calltally.operators import batch as batches
from calltally.plans.inputs import completions, pairs, table
from calltally.plans.registry import query
from calltally.plans.stems import stem_ctes
from calltally.plans.twins import PAIRS_CTE, over, over_completions, words


def bleu_parts(base: str) -> str:
    """CTEs up to `bleu_scores` (id, bleu) over a table of (id, prompt, response)."""
    return f"""word_lists AS (SELECT id, {words('lower(prompt)')} AS r, {words('lower(response)')} AS c FROM {base}),
grams AS (
  SELECT id, n, 1 AS rr, 0 AS cc, unnest(list_transform(range(1, len(r) - n + 2),
    lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM word_lists, (VALUES (1), (2), (3), (4)) o(n)
  UNION ALL
  SELECT id, n, 0, 1, unnest(list_transform(range(1, len(c) - n + 2),
    lambda i: array_to_string(c[i:i + n - 1], ' '))) FROM word_lists, (VALUES (1), (2), (3), (4)) o(n)),
folded_grams AS (SELECT id, n, g, sum(rr) AS rr, sum(cc) AS cc FROM grams GROUP BY id, n, g),
clipped AS (SELECT id, n, sum(least(rr, cc)) AS m FROM folded_grams GROUP BY id, n),
wide AS (SELECT t.id, CAST(len(r) AS DOUBLE) AS lr, CAST(len(c) AS DOUBLE) AS lc, r = c AS same,
    coalesce(max(m) FILTER (WHERE n = 1), 0) AS m1, coalesce(max(m) FILTER (WHERE n = 2), 0) AS m2,
    coalesce(max(m) FILTER (WHERE n = 3), 0) AS m3, coalesce(max(m) FILTER (WHERE n = 4), 0) AS m4
  FROM word_lists t LEFT JOIN clipped k ON k.id = t.id GROUP BY t.id, r, c),
zeros AS (SELECT *, CASE WHEN m2 = 0 THEN 1 ELSE 0 END AS z2,
    CASE WHEN m2 = 0 THEN 1 ELSE 0 END + CASE WHEN m3 = 0 THEN 1 ELSE 0 END AS z3,
    CASE WHEN m2 = 0 THEN 1 ELSE 0 END + CASE WHEN m3 = 0 THEN 1 ELSE 0 END
      + CASE WHEN m4 = 0 THEN 1 ELSE 0 END AS z4 FROM wide),
bleu_scores AS ({BLEU_SQL})"""


def _part(order: int) -> str:
    grams = f"greatest(1, lc - {order - 1})"
    smoothed = f"ln(lc) / (pow(2, z{order}) * 5) / {grams}"
    return (
        f"coalesce(ln(CASE WHEN m{order} > 0 THEN m{order} / {grams}"
        f" WHEN lc > 1 THEN {smoothed} END) / 4, 0)"
    )


BLEU_SQL = f"""SELECT id, round(CASE WHEN lc = 0 THEN 0.0 WHEN same THEN 1.0 WHEN m1 = 0 THEN 0.0
  ELSE CASE WHEN lc > lr THEN 1.0 ELSE exp(1 - lr / lc) END
    * exp(ln(m1 / greatest(1, lc)) / 4 + {_part(2)} + {_part(3)} + {_part(4)}) END, 6) AS bleu FROM zeros"""


@query("txt1_bleu", over("SELECT id, bleu FROM bleu_scores", PAIRS_CTE, bleu_parts("pairs")))
def _(spark, folder):
    scored = text_scores.text_scores(pairs(spark, folder), "id", rouge=False)
    return scored.select("id", F.round("bleu", 6).alias("bleu"))


F1 = "round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4)"


def _stemmed_tokens(base: str) -> str:
    def side(name: str) -> str:
        return f"""stemmed_{name} AS (SELECT id, list(coalesce(stem, g) ORDER BY place) AS x
  FROM (SELECT id, unnest({name}) AS g, generate_subscripts({name}, 1) AS place FROM raw_tokens)
  LEFT JOIN stems ON word = g GROUP BY id)"""

    return f"""raw_tokens AS (SELECT id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS r,
    regexp_extract_all(lower(response), '[a-z0-9]+') AS c FROM {base}),
stem_words AS (SELECT unnest(r) AS word FROM raw_tokens UNION ALL SELECT unnest(c) FROM raw_tokens),
{stem_ctes("stem_words")}, {side("r")}, {side("c")},
tokens AS (SELECT t.id, coalesce(a.x, []) AS r, coalesce(b.x, []) AS c FROM raw_tokens t
  LEFT JOIN stemmed_r a ON a.id = t.id LEFT JOIN stemmed_c b ON b.id = t.id)"""


def rouge_parts(base: str, stemming: bool = False) -> str:
    """CTEs up to `rouge_scores` (id, rouge1, rougeL).

    The common subsequence is the classic table, one reference token per step: the best value up
    to a column is the running maximum of the value above and, where tokens match, the value
    above left plus one.
    """
    plain = f"""tokens AS (SELECT id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS r,
    regexp_extract_all(lower(response), '[a-z0-9]+') AS c FROM {base})"""
    return f"""{_stemmed_tokens(base) if stemming else plain},
sides AS (SELECT id, 1 AS rr, 0 AS cc, unnest(r) AS g FROM tokens
  UNION ALL SELECT id, 0, 1, unnest(c) FROM tokens),
folded AS (SELECT id, g, sum(rr) AS rr, sum(cc) AS cc FROM sides GROUP BY id, g),
met AS (SELECT id, CAST(sum(least(rr, cc)) AS DOUBLE) AS m FROM folded GROUP BY id),
shares AS (SELECT t.id, coalesce(m, 0) / greatest(len(c), 1) AS p, coalesce(m, 0) / greatest(len(r), 1) AS q
  FROM tokens t LEFT JOIN met ON met.id = t.id),
cells AS (
  SELECT id, 0 AS i, j, 0 AS v FROM (SELECT id, unnest(range(0, len(c) + 1)) AS j FROM tokens)
  UNION ALL
  SELECT id, i, j, max(w) OVER (PARTITION BY id ORDER BY j) AS v FROM (
    SELECT p.id, p.i + 1 AS i, p.j, CASE WHEN p.j > 0 AND t.c[p.j] = t.r[p.i + 1]
      THEN lag(p.v) OVER (PARTITION BY p.id ORDER BY p.j) + 1 ELSE p.v END AS w
    FROM cells p JOIN tokens t ON t.id = p.id WHERE p.i < len(t.r))
),
lcs AS (SELECT t.id, max(len(r)) AS lr, max(len(c)) AS lc, max(coalesce(v, 0)) AS v
  FROM tokens t LEFT JOIN cells k ON k.id = t.id GROUP BY t.id),
lcs_shares AS (SELECT id, CAST(v AS DOUBLE) / greatest(lc, 1) AS p, CAST(v AS DOUBLE) / greatest(lr, 1) AS q
  FROM lcs),
rouge_scores AS (SELECT a.id, a.f AS rouge1, b.f AS "rougeL"
  FROM (SELECT id, {F1} AS f FROM shares) a JOIN (SELECT id, {F1} AS f FROM lcs_shares) b ON b.id = a.id)"""


def over_recursive(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + over(body, *ctes).removeprefix("WITH ")


@query(
    "txt2_txt3_rouge_unstemmed",
    over_recursive('SELECT id, rouge1, "rougeL" FROM rouge_scores', PAIRS_CTE, rouge_parts("pairs")),
)
def _(spark, folder):
    return text_scores.text_scores(pairs(spark, folder), "id", bleu=False, stemming=False)


@query(
    "txt2_txt3_rouge",
    over_recursive('SELECT id, rouge1, "rougeL" FROM rouge_scores', PAIRS_CTE, rouge_parts("pairs", stemming=True)),
)
def _(spark, folder):
    return text_scores.text_scores(pairs(spark, folder), "id", bleu=False)


def _combined(scored):
    both = F.col("rouge1"), F.col("rougeL")
    return scored.select(
        "id",
        F.round(text_scores.combined_rouge(*both), 6).alias("rouge_mean"),
        text_scores.combined_rouge(*both, "rougeL").alias("rouge_benchmark"),
    )


@query(
    "txt4_combined_rouge",
    over_recursive(
        'SELECT id, round((rouge1 + "rougeL") / 2, 6) AS rouge_mean, "rougeL" AS rouge_benchmark FROM rouge_scores',
        PAIRS_CTE,
        rouge_parts("pairs", stemming=True),
    ),
)
def _(spark, folder):
    return _combined(text_scores.text_scores(pairs(spark, folder), "id", bleu=False))


@query(
    "txt4_combined_rouge_unstemmed",
    over_recursive(
        'SELECT id, round((rouge1 + "rougeL") / 2, 6) AS rouge_mean, "rougeL" AS rouge_benchmark FROM rouge_scores',
        PAIRS_CTE,
        rouge_parts("pairs"),
    ),
)
def _(spark, folder):
    return _combined(
        text_scores.text_scores(pairs(spark, folder), "id", bleu=False, stemming=False)
    )


SETS_CTE = f"""{PAIRS_CTE},
sets AS (SELECT id, list_distinct({words('lower(prompt)')}) AS a,
    list_distinct({words('lower(response)')}) AS b FROM pairs)"""


@query(
    "txt5_jaccard",
    over(
        """SELECT id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0
  ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS similarity FROM sets""",
        SETS_CTE,
    ),
)
def _(spark, folder):
    return pairs(spark, folder).select(
        "id", text_scores.jaccard(F.col("prompt"), F.col("response")).alias("similarity")
    )


@query(
    "u5_word_sets",
    over(
        """SELECT id, CAST(len(list_intersect(a, b)) AS INT) AS shared,
  CAST(len(list_distinct(list_concat(a, b))) AS INT) AS either FROM sets""",
        SETS_CTE,
    ),
)
def _(spark, folder):
    a = F.array_distinct(folded_words(F.col("prompt")))
    b = F.array_distinct(folded_words(F.col("response")))
    return pairs(spark, folder).select(
        "id",
        F.size(F.array_intersect(a, b)).alias("shared"),
        F.size(F.array_union(a, b)).alias("either"),
    )


@query(
    "txt6_cosine",
    """SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(
    CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding")
    )
    similarity = text_scores.cosine(F.col("embedding"), F.col("next_embedding"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(similarity, 4).alias("similarity")
    )


RULES = [
    ("number", r"\d+", 1.0),
    ("link", r"https?://", 2.0),
    ("licence", r"licen[cs]e", 1.5),
    ("mail", r"@[a-z0-9-]+\.[a-z]{2}", 2.0),
    ("table", r"\|.*\|", 0.5),
    ("bullet", r"(^|\n)[-*] ", 1.0),
]


def demo_rules() -> rules.RuleSet:
    added = rules.RuleSet()
    for name, regex, weight in RULES:
        added.add(name, regex, weight)
    return added


def _hit(regex: str) -> str:
    return f"regexp_matches(text, '{regex}', 'is')"


TOTAL_WEIGHT = sum(weight for _, _, weight in RULES)
MATCHED = " + ".join(f"CASE WHEN {_hit(regex)} THEN {weight} ELSE 0 END" for _, regex, weight in RULES)


@query(
    "txt7_rules",
    f"""SELECT doc_id, round(CAST({MATCHED} AS DOUBLE) / {TOTAL_WEIGHT}, 4) AS weighted_score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_hit(regex)} THEN '{name}' END" for name, regex, _ in RULES)}],
    lambda x: x IS NOT NULL), ',') AS matched FROM documents""",
)
def _(spark, folder):
    judged = rules.evaluate_rules(table(spark, folder, "documents"), demo_rules(), "text")
    hits = F.map_filter("rule_matches", lambda name, hit: hit)
    return judged.select(
        "doc_id", "weighted_score", F.array_join(F.map_keys(hits), ",").alias("matched")
    )


@query(
    "txt7_rule_hit_rates",
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(*) FILTER (WHERE {_hit(regex)}) AS hits,
  round(count(*) FILTER (WHERE {_hit(regex)}) / count(*), 4) AS hit_rate FROM documents"""
        for name, regex, _ in RULES
    ),
)
def _(spark, folder):
    return rules.rule_hit_rates(table(spark, folder, "documents"), demo_rules(), "text")


def _judged_documents(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Write in "), F.col("lang")).alias("prompt"),
        F.col("text").alias("response"),
        F.when(F.col("lang") == "en", "clarity").alias("criteria"),
    )


KEY_SQL = f"""sha256('Write in ' || lang || '||' || text || '||'
  || CASE WHEN lang = 'en' THEN 'clarity' ELSE '{values.JUDGE_CRITERIA}' END)"""
REQUEST_SQL = "'" + values.JUDGE_TEMPLATE.format(
    criteria=f"' || CASE WHEN lang = 'en' THEN 'clarity' ELSE '{values.JUDGE_CRITERIA}' END || '",
    prompt="Write in ' || lang || '",
    response="' || text || '",
) + "'"
EXPLANATION_SQL = (
    "'" + values.EXPLANATION_TEMPLATE.format(prompt="Write in ' || lang || '", response="' || text || '")
    + "' || CASE WHEN lang = 'en' THEN '" + values.EXPLANATION_CRITERIA.format(criteria="clarity") + "' ELSE '' END"
)


@query(
    "txt8_judge_requests",
    f"""WITH keyed AS (SELECT doc_id AS id, lang, {KEY_SQL} AS content_key, {REQUEST_SQL} AS request FROM documents),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY id) = 1)
SELECT id, content_key, request FROM firsts
WHERE content_key NOT IN (SELECT content_key FROM keyed WHERE lang = 'de')""",
)
def _(spark, folder):
    """Requests for texts whose key was not scored before; the German documents were."""
    rows = _judged_documents(spark, folder)
    scored = rows.where(F.col("prompt") == "Write in de")
    cache = judge.judge_requests(scored, "id").select("content_key")
    return judge.judge_requests(rows, "id", cache)


@query("txt8_explanation_requests", f"SELECT doc_id AS id, {EXPLANATION_SQL} AS request FROM documents")
def _(spark, folder):
    return judge.explanation_requests(_judged_documents(spark, folder), "id")


ANSWER_SQL = """CASE event_id % 7 WHEN 0 THEN '{"score": ' || CAST(event_id % 13 AS VARCHAR) || ', "explanation": "'
      || repeat('because ', event_id % 90) || '"}'
    WHEN 1 THEN ' {"score": "7"} ' WHEN 2 THEN '{"score": 99, "explanation": ""}'
    WHEN 3 THEN '{"score": -5}' WHEN 4 THEN 'Score: 8' WHEN 5 THEN '{"rating": 3}'
    ELSE '{"score": 8.5, "explanation": "clear"}' END"""


@query(
    "txt9_parsed_answers",
    f"""WITH told AS (SELECT event_id, {ANSWER_SQL} AS answer FROM events),
valid AS (SELECT event_id, CASE WHEN json_valid(answer) THEN answer END AS answer FROM told)
SELECT event_id,
  coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, TRY_CAST(json_extract_string(answer, '$.score') AS DOUBLE) / 10)), 0)
    AS score, nullif(substr(json_extract_string(answer, '$.explanation'), 1, 500), '') AS explanation
FROM valid""",
)
def _(spark, folder):
    event = F.col("event_id")
    long = F.concat(
        F.lit('{"score": '), (event % 13).cast("string"), F.lit(', "explanation": "'),
        F.repeat(F.lit("because "), (event % 90).cast("int")), F.lit('"}'),
    )
    answer = (
        F.when(event % 7 == 0, long)
        .when(event % 7 == 1, ' {"score": "7"} ')
        .when(event % 7 == 2, '{"score": 99, "explanation": ""}')
        .when(event % 7 == 3, '{"score": -5}')
        .when(event % 7 == 4, "Score: 8")
        .when(event % 7 == 5, '{"rating": 3}')
        .otherwise('{"score": 8.5, "explanation": "clear"}')
    )
    told = table(spark, folder, "events").select("event_id", answer.alias("answer"))
    return judge.parse_answers(told, "answer").select("event_id", "score", "explanation")


def by_length(rows):
    """A stand-in judge: a pure function of the response, scored per pandas batch."""
    return (rows["response"].str.len() % 11) / 10


@query(
    "txt10_txt12_batch_scores",
    over_completions(
        """SELECT id AS completion_id, 'length_judge' AS eval_type, (length(response) % 11) / 10 AS score
FROM completions WHERE id IN (SELECT event_id * 2 FROM events)"""
    ),
)
def _(spark, folder):
    ids = table(spark, folder, "events").select((F.col("event_id") * 2).alias("id"))
    known = batches.Evaluators().register("length_judge", batches.batch_evaluator(by_length))
    return batches.evaluate_batch(
        completions(spark, folder), ids, ["length_judge", "unheard_of"], known
    )


@query(
    "txt10_sampled_text_scores",
    over_recursive(
        """SELECT id AS completion_id, 'bleu' AS eval_type, round(bleu, 6) AS score FROM bleu_scores
UNION ALL SELECT id, 'rouge', round((rouge1 + "rougeL") / 2, 6) FROM rouge_scores""",
        PAIRS_CTE,
        """asked AS (SELECT DISTINCT conv_id * 1000000 + turn AS id FROM conversations WHERE role = 'user'),
sampled AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '|3'), id) AS place,
    count(*) OVER () AS total FROM asked) WHERE place <= greatest(1, CAST(floor(total * 0.5::DOUBLE) AS BIGINT))),
chosen AS (SELECT * FROM pairs WHERE id IN (SELECT id FROM sampled))""",
        bleu_parts("chosen"),
        rouge_parts("chosen", stemming=True),
    ),
)
def _(spark, folder):
    turns = table(spark, folder, "conversations").where(F.col("role") == "user")
    ids = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"))
    return batches.evaluate_batch(
        pairs(spark, folder), ids, ["bleu", "rouge"], batches.Evaluators(), share=0.5, seed="3"
    ).withColumn("score", F.round("score", 6))
