"""Evaluating sets of completions with named evaluators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltally.functions import numbers
from calltally.operators.filters import sample_rows
from calltally.operators.text_scores import combined_rouge, text_scores
from calltally.session import cut_lineage

# From rows (id, prompt, response, criteria) to rows (id, score).
Evaluator = Callable[[DataFrame], DataFrame]


def bleu_evaluator(rows: DataFrame) -> DataFrame:
    return text_scores(rows, "id", rouge=False).select("id", F.col("bleu").alias("score"))


def rouge_evaluator(rows: DataFrame) -> DataFrame:
    scored = text_scores(rows, "id", bleu=False)
    return scored.select("id", combined_rouge(F.col("rouge1"), F.col("rougeL")).alias("score"))


def batch_evaluator(score: Callable[[pd.DataFrame], pd.Series]) -> Evaluator:
    """An evaluator from a function that scores a pandas batch of (id, prompt, response, criteria).

    This is where an external judge plugs in; batches arrive as Spark partitions the rows. A batch
    that fails is scored row by row, and a row that fails scores 0.
    """

    def row_by_row(rows: pd.DataFrame) -> list[float]:
        scores = []
        for at in range(len(rows)):
            try:
                scores.append(float(score(rows.iloc[at : at + 1]).iloc[0]))
            except Exception:  # an evaluator may raise anything; its row counts as 0
                scores.append(0.0)
        return scores

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                scores = score(rows).astype("float64").to_numpy()
            except Exception:
                scores = row_by_row(rows)
            yield pd.DataFrame({"id": rows["id"], "score": scores})

    return lambda rows: rows.mapInPandas(run, "id bigint, score double")


BUILT_IN: Mapping[str, Evaluator] = {"bleu": bleu_evaluator, "rouge": rouge_evaluator}


class Evaluators:
    """Evaluators by name; asking for an unknown one is an error."""

    def __init__(self, known: Mapping[str, Evaluator] | None = None):
        self._known = dict(BUILT_IN if known is None else known)

    def register(self, name: str, evaluator: Evaluator) -> Evaluators:
        self._known[name] = evaluator
        return self

    def names(self) -> list[str]:
        return list(self._known)

    def built_in(self, name: str) -> bool:
        return name in BUILT_IN and self._known.get(name) is BUILT_IN[name]

    def evaluate(self, name: str, rows: DataFrame) -> DataFrame:
        """(id, score) with scores in 0–1; a score that cannot be had counts as 0."""
        if name not in self._known:
            raise ValueError(f"unknown evaluator: {name}")
        wanted = rows.select("id")
        try:
            scored = self._known[name](rows)
        except Exception:  # one that can't be set up leaves the other evaluators' scores alone
            return wanted.select("id", F.lit(0.0).alias("score"))
        return wanted.join(scored.select("id", "score"), "id", "left").select(
            "id", F.coalesce(numbers.clamp01(F.col("score")), F.lit(0.0)).alias("score")
        )


def requested_rows(completions: DataFrame, ids: DataFrame, share: float = 1.0, seed: str = "0"):
    """Completions asked for by id; ids without a completion are skipped.

    Sampling passes over the ids more than once, so the distinct ids are checkpointed for it.
    """
    asked = ids.select("id").distinct()
    if share < 1.0:
        asked = sample_rows(cut_lineage(asked), share, seed)
    return completions.join(asked, "id", "left_semi")


def evaluate_batch(
    completions: DataFrame,
    ids: DataFrame,
    eval_types: Sequence[str],
    evaluators: Evaluators,
    share: float = 1.0,
    seed: str = "0",
    criteria: str = "",
) -> DataFrame:
    """Scores in long form for the asked completions; unknown types are ignored.

    BLEU and ROUGE come from one job. Any other evaluator adds its own; with more than one part
    the asked rows are checkpointed, so that they are not looked up again for each.
    """
    rows = requested_rows(completions, ids, share, seed).select(
        "id", "prompt", "response", F.lit(criteria).alias("criteria")
    )
    wanted = [name for name in dict.fromkeys(eval_types) if name in evaluators.names()]
    if not wanted:
        raise ValueError("no known eval type was asked for")
    overlaps = [name for name in wanted if evaluators.built_in(name)]
    others = [name for name in wanted if name not in overlaps]
    if bool(overlaps) + len(others) > 1:
        rows = cut_lineage(rows)
    parts = []
    if overlaps:
        scored = text_scores(rows, "id", bleu="bleu" in overlaps, rouge="rouge" in overlaps)
        if "rouge" in overlaps:
            scored = scored.withColumn("rouge", combined_rouge(F.col("rouge1"), F.col("rougeL")))
        parts.append(scored.unpivot(["id"], overlaps, "eval_type", "score"))
    for name in others:
        scored = evaluators.evaluate(name, rows)
        parts.append(scored.select("id", F.lit(name).alias("eval_type"), "score"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumnRenamed("id", "completion_id")


def batch_progress(requests: DataFrame, evals: DataFrame, completions: DataFrame | None = None) -> DataFrame:
    """Per job: ids asked for, ids done, and whether it is complete.

    requests: (job_id, id). Scores are folded to one row per completion before the join. With
    `completions`, an id that has none is skipped work: it counts as done.
    """
    scored = evals.groupBy("completion_id").agg(F.lit(1).alias("_scored"))
    joined = requests.join(scored, requests["id"] == scored["completion_id"], "left")
    done = F.col("_scored").isNotNull()
    if completions is not None:
        known = completions.select(F.col("id").alias("_known")).distinct()
        joined = joined.join(known, joined["id"] == known["_known"], "left")
        done = done | F.col("_known").isNull()
    counted = joined.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(done, 1)).alias("done")
    )
    return counted.withColumn(
        "status", F.when(F.col("done") >= F.col("total"), "complete").otherwise("processing")
    )
