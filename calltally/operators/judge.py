"""Preparing texts for an external judge and reading its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltally import values
from calltally.functions import numbers, text


def judge_prompt(prompt: Column, response: Column, criteria: Column) -> Column:
    """The fixed template with its three places filled."""
    filled = {"criteria": criteria, "prompt": prompt, "response": response}
    pieces: list[Column] = []
    rest = values.JUDGE_TEMPLATE
    for name in ("criteria", "prompt", "response"):
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), F.coalesce(filled[name], F.lit(""))]
    pieces.append(F.lit(rest.replace("{{", "{").replace("}}", "}")))
    return F.concat(*pieces)


def judge_requests(
    df: DataFrame,
    id_column: str,
    cache: DataFrame | None = None,
    criteria: str | None = None,
) -> DataFrame:
    """One request per distinct (prompt, response, criteria) that the cache does not hold.

    Copies of one text are folded by key and id alone; the smallest id, which is unique, stands for
    them, and only its row's texts are fetched.
    """
    asked = F.col("criteria") if criteria is None else F.lit(criteria)
    asked = F.coalesce(asked, F.lit(values.JUDGE_CRITERIA))
    keys = df.select(
        F.col(id_column), text.content_key(F.col("prompt"), F.col("response"), asked).alias("content_key")
    )
    wanted = keys.groupBy("content_key").agg(F.min(id_column).alias(id_column))
    if cache is not None:
        wanted = wanted.join(cache.select("content_key"), "content_key", "left_anti")
    texts = df.select(id_column, judge_prompt(F.col("prompt"), F.col("response"), asked).alias("request"))
    return wanted.join(texts, id_column).select(id_column, "content_key", "request")


def explanation_prompt(prompt: Column, response: Column, criteria: Column) -> Column:
    """The fixed request for an explanation; criteria are named only if there are any."""
    before, rest = values.EXPLANATION_TEMPLATE.split("{prompt}", 1)
    between, after = rest.split("{response}", 1)
    named = values.EXPLANATION_CRITERIA.split("{criteria}", 1)
    empty = F.lit("")
    return F.concat(
        F.lit(before), F.coalesce(prompt, empty), F.lit(between), F.coalesce(response, empty), F.lit(after),
        F.when(F.coalesce(criteria, empty) != "", F.concat(F.lit(named[0]), criteria, F.lit(named[1]))).otherwise(empty),
    )


def explanation_requests(df: DataFrame, id_column: str, criteria: str | None = None) -> DataFrame:
    """One request for an explanation per row."""
    asked = F.col("criteria") if criteria is None else F.lit(criteria)
    return df.select(
        id_column, explanation_prompt(F.col("prompt"), F.col("response"), asked).alias("request")
    )


def unjudged(completions: DataFrame, evals: DataFrame, source: str = values.BENCHMARK) -> DataFrame:
    """Completions of a source that carry no judge score yet."""
    judged = evals.where(F.col("eval_type") == "llm_judge").select(
        F.col("completion_id").alias("_judged")
    )
    wanted = completions.where(F.col("source") == source)
    return wanted.join(judged, wanted["id"] == judged["_judged"], "left_anti")


def parsed_score(answer: Column) -> Column:
    """Score 0–10 in a JSON answer as 0–1; an answer that cannot be read scores 0."""
    number = F.try_variant_get(F.try_parse_json(answer), "$.score", "double")
    return F.coalesce(numbers.clamp01(number / 10), F.lit(0.0))


def explanation_text(explanation: Column, limit: int = 500) -> Column:
    """The first `limit` characters; an empty explanation is stored as missing."""
    return F.nullif(F.substring(explanation, 1, limit), F.lit(""))


def parse_answers(df: DataFrame, answer: str, explanation: str | None = None) -> DataFrame:
    document = F.try_parse_json(F.col(answer))
    told = (
        F.col(explanation)
        if explanation
        else F.try_variant_get(document, "$.explanation", "string")
    )
    return df.withColumns(
        {"score": parsed_score(F.col(answer)), "explanation": explanation_text(told)}
    )
