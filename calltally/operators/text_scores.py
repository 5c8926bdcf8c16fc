"""Overlap scores of a reference and a candidate text, as jobs over whole datasets.

BLEU-4 and ROUGE-1 need clipped n-gram matches. They are counted within the row, over its sorted
n-grams, so no n-gram is ever a row: only ids and finished scores are shuffled, to find repeated ids.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from calltally.functions import numbers, text
from calltally.functions.stemmer import stem
from calltally.functions.subsequence import common_length

# N-gram orders of BLEU, and the smoothing constant of Chen & Cherry's method 4.
ORDERS = (1, 2, 3, 4)
SMOOTHING = 5.0
# Tokens up to this length are not stemmed.
UNSTEMMED_LENGTH = 3

STEMMED = StructType(
    [StructField("_ref_stems", StringType()), StructField("_cand_stems", StringType()), StructField("_lcs", LongType())]
)


# Tokens travel as one string a row: a worker holds lists of tokens for one row at a time only.
@F.pandas_udf(STEMMED)
def stemmed(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """The stems of both sides and the length of their common subsequence, from one worker a task."""
    rows = []
    for pair in zip(reference, candidate):
        a, b = ([stem(t) if len(t) > UNSTEMMED_LENGTH else t for t in side.split()] for side in pair)
        rows.append((" ".join(a), " ".join(b), common_length(a, b)))
    return pd.DataFrame(rows, columns=["_ref_stems", "_cand_stems", "_lcs"])


@F.pandas_udf(LongType())
def subsequence_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([common_length(a.split(), b.split()) for a, b in zip(left, right)], dtype="int64")


def _grams(tokens: Column, order: int) -> Column:
    count = F.size(tokens) - (order - 1)
    if order == 1:
        return tokens
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: F.array_join(F.slice(tokens, i, order), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _clipped(reference: Column, candidate: Column) -> Column:
    """Matches of two gram lists, each gram counted at most as often as the lesser side has it.

    One pass over the sorted grams of both: a gram's reference entries come first and are open until
    a candidate entry of the same gram takes one.
    """

    def side(grams: Column, mark: int) -> Column:
        return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(mark).alias("side")))

    def step(state: Column, entry: Column) -> Column:
        left = F.when(state["gram"] == entry["gram"], state["left"]).otherwise(0)
        hit = (entry["side"] == 1) & (left > 0)
        return F.struct(
            entry["gram"].alias("gram"),
            F.when(hit, left - 1).when(entry["side"] == 0, left + 1).otherwise(left).alias("left"),
            F.when(hit, state["met"] + 1).otherwise(state["met"]).alias("met"),
        )

    none = F.struct(F.lit("").alias("gram"), F.lit(0).alias("left"), F.lit(0).alias("met"))
    entries = F.sort_array(F.concat(side(reference, 0), side(candidate, 1)))
    met = F.aggregate(entries, none, step, lambda state: state["met"])
    return F.when(F.arrays_overlap(reference, candidate), met).otherwise(0).cast("bigint")


def _bleu_column() -> Column:
    """Closed form over clipped matches m1..m4, candidate length and reference length."""
    length, target = F.col("cand_words"), F.col("ref_words")
    zeros = F.lit(0)
    total = F.lit(0.0)
    for order in ORDERS:
        matches = F.col(f"m{order}")
        grams = F.greatest(F.lit(1), length - (order - 1))
        zeros = zeros + F.when(matches == 0, 1).otherwise(0)
        smoothed = F.log(length) / (F.pow(F.lit(2.0), zeros) * SMOOTHING)
        part = F.when(matches > 0, matches / grams).when(length > 1, smoothed / grams)
        total = total + F.coalesce(F.log(part) / len(ORDERS), F.lit(0.0))
    penalty = F.when(length > target, F.lit(1.0)).otherwise(F.exp(1 - target / F.nullif(length, F.lit(0))))
    return (
        F.when(length == 0, F.lit(0.0))
        .when(F.col("same") == 1, F.lit(1.0))
        .when(F.col("m1") == 0, F.lit(0.0))
        .otherwise(penalty * F.exp(total))
    )


def _f1(matches: Column, reference: Column, candidate: Column) -> Column:
    """Harmonic mean of precision and recall, 4 decimals; nothing to compare gives 0."""
    precision = matches / F.greatest(candidate, F.lit(1))
    recall = matches / F.greatest(reference, F.lit(1))
    both = precision + recall
    return F.round(
        F.when(both > 0, 2 * precision * recall / F.nullif(both, F.lit(0.0))).otherwise(0.0), 4
    )


def text_scores(
    pairs: DataFrame,
    id_column: str,
    reference: str = "prompt",
    candidate: str = "response",
    bleu: bool = True,
    rouge: bool = True,
    stemming: bool = True,
) -> DataFrame:
    """Per id: `bleu`, `rouge1`, `rougeL` (those asked for). Two rows with one id are an error."""
    slim = pairs.select(
        F.col(id_column),
        F.coalesce(F.col(reference), F.lit("")).alias("_ref"),
        F.coalesce(F.col(candidate), F.lit("")).alias("_cand"),
    )
    scores: list[str] = []
    if bleu:
        slim = slim.withColumns(
            {"_ref_words": text.folded_words(F.col("_ref")), "_cand_words": text.folded_words(F.col("_cand"))}
        )
        sides = F.col("_ref_words"), F.col("_cand_words")
        slim = slim.withColumns(
            {
                "same": (sides[0] == sides[1]).cast("int"),
                "ref_words": F.size(sides[0]).cast("bigint"),
                "cand_words": F.size(sides[1]).cast("bigint"),
                **{f"_{name}{order}": _grams(side, order) for order in ORDERS for name, side in zip("rc", sides)},
            }
        )
        slim = slim.withColumns({f"m{order}": _clipped(F.col(f"_r{order}"), F.col(f"_c{order}")) for order in ORDERS})
        slim = slim.withColumn("bleu", _bleu_column())
        scores.append("bleu")
    if rouge:
        tokens = [F.array_join(text.alnum_tokens(F.col(side)), " ") for side in ("_ref", "_cand")]
        if stemming:
            slim = slim.withColumn("_stemmed", stemmed(*tokens)).select("*", "_stemmed.*")
        else:
            slim = slim.withColumns(dict(zip(("_ref_stems", "_cand_stems"), tokens)))
            slim = slim.withColumn("_lcs", subsequence_length("_ref_stems", "_cand_stems"))
        slim = slim.withColumns(
            {f"{side}_list": F.array_remove(F.split(side, " "), "") for side in ("_ref_stems", "_cand_stems")}
        )
        lists = F.col("_ref_stems_list"), F.col("_cand_stems_list")
        sizes = [F.size(side).cast("bigint") for side in lists]
        slim = slim.withColumns({"rouge1": _f1(_clipped(*lists), *sizes), "rougeL": _f1(F.col("_lcs"), *sizes)})
        scores += ["rouge1", "rougeL"]
    found = slim.groupBy(id_column).agg(F.count(F.lit(1)).alias("_rows"), *[F.max(name).alias(name) for name in scores])
    repeated = F.raise_error(F.concat(F.lit("two rows with the id "), F.col(id_column).cast("string")))
    kind = pairs.schema[id_column].dataType
    checked = F.when(F.col("_rows") > 1, repeated.cast(kind)).otherwise(F.col(id_column)).alias(id_column)
    return found.select(checked, *scores)


def combined_rouge(rouge1: Column, rouge_l: Column, variant: str = "mean") -> Column:
    """One ROUGE number: the mean of both (uploads, requests) or ROUGE-L alone (benchmark load)."""
    if variant not in ("mean", "rougeL"):
        raise ValueError(f"unknown variant: {variant}")
    return (rouge1 + rouge_l) / 2 if variant == "mean" else rouge_l


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of the two lower-cased word sets; two empty texts are alike, one is not."""
    a, b = F.array_distinct(text.folded_words(left)), F.array_distinct(text.folded_words(right))
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(
        numbers.ratio(F.size(F.array_intersect(a, b)).cast("double"), both)
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors clamped to 0–1; a zero vector gives 0."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    scale = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return numbers.clamp01(numbers.ratio(dot(left, right), scale))
