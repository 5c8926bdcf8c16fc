"""Stages of the corpus pipeline: (spark, docs, folder) → rows of `docs`, or what replaces them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.llm import decontamination, packing, pii, simhash, toxicity
from calltally.llm.common import columns, table

TOKENIZER = "byte_bpe_50k.json"
TOXIC = 0.3  # the limit of op5_toxicity
PII_KEY = "calltally"  # of the registered query; a deployment passes its own secret
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of `rows` rows from here on, unless the session has chosen a number itself.

    Whole texts travel in them: of 10 000 rows, Spark's default, one batch takes tens of MB several times
    over in the executor and in the Python worker of every core.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, rows)


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that score `TOXIC` or more; the model learns from the labelled ones among `docs`."""
    _short_batches(spark)
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, name="__score").where(F.col("__score") < TOXIC).select(*columns(docs))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    _short_batches(spark)
    return simhash.first_of_each(docs, "doc_id", "text").select(*columns(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold a passage of a benchmark item."""
    _short_batches(spark)
    return decontamination.without_matches(docs, table(spark, folder, "benchmark")).select(*columns(docs))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Private values replaced in `text`; every document stays, and `n_chars` follows the new text."""
    out = pii.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    _short_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))
