"""Stored tables: appends, registry, refreshes, versioned deletes and retention.

Tables are Parquet folders. Deletes never overwrite what they read: they write a new version next
to the old one and return its path, and callers switch to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.operators import etl, rollups
from calltally.operators.quality import eval_rules, split_valid
from calltally.session import discard, scratch_path


def batch_folder(path: str, batch_id: str) -> str:
    if not re.fullmatch(r"[\w.-]+", batch_id):
        raise ValueError(f"not usable as a folder name: {batch_id}")
    return f"{path}/batch_id={batch_id}"


def append_completions(df: DataFrame, path: str, batch_id: str) -> None:
    """Append completions, laid out by source and day, sorted by model and time within a file.

    A batch is one folder and replaces itself when it runs again, so a replay adds nothing twice.
    Rebalancing gathers a day's rows into few files and splits an oversized day.
    """
    (
        df.withColumn("date", F.to_date("timestamp"))
        .hint("rebalance", "source", "date")
        .sortWithinPartitions("source", "date", "model", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("source", "date")
        .parquet(batch_folder(path, batch_id))
    )


def append_evals(df: DataFrame, path: str, batch_id: str) -> None:
    (
        df.hint("rebalance", "eval_type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("eval_type")
        .parquet(batch_folder(path, batch_id))
    )


@contextmanager
def _staged(df: DataFrame) -> Iterator[DataFrame]:
    """`df` written once and read from there; removed after use."""
    spark = df.sparkSession
    path = scratch_path(spark, "staged")
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        discard(spark, path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Stored rows without the layout columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    return table.drop("batch_id", "date")


def load_battles(
    battles: DataFrame, root: str, anchor, batch_id: str = "battles", first_id: int = 0
) -> None:
    """Store completions and preference scores of a battle file from one set of ids.

    The sides are written once; both tables are built from the written rows.
    """
    with _staged(etl.battle_sides(battles, anchor, first_id)) as sides:
        append_completions(etl.completions_of(sides), f"{root}/completions", batch_id)
        append_evals(etl.preference_evals(sides, anchor), f"{root}/evals", batch_id)


def load_benchmark(
    rows: DataFrame, root: str, anchor, batch_id: str = "benchmark", first_id: int = 0
) -> None:
    with _staged(etl.benchmark_rows(rows, anchor, first_id)) as loaded:
        append_completions(etl.completions_of(loaded), f"{root}/completions", batch_id)
        append_evals(etl.benchmark_evals(loaded, anchor), f"{root}/evals", batch_id)


def load_upload(
    rows: DataFrame, root: str, source_id: str, filename: str, uploaded_at, first_id: int = 0
) -> None:
    """Store an uploaded dataset, its scores and its registry row; a replay replaces all three."""
    with _staged(etl.upload_rows(rows, source_id, uploaded_at, first_id)) as loaded:
        if loaded.isEmpty():
            raise ValueError("no row has both a prompt and a response")
        append_completions(etl.completions_of(loaded), f"{root}/completions", source_id)
        append_evals(etl.upload_evals(loaded, uploaded_at), f"{root}/evals", source_id)
        entry = registry_row(loaded, source_id, filename, rows.columns, uploaded_at)
        entry.write.mode("overwrite").parquet(batch_folder(f"{root}/uploads", source_id))


def registry_row(
    completions: DataFrame, source_id: str, filename: str, columns: Sequence[str], created_at
) -> DataFrame:
    """The registry row of one dataset. The registry id is the digits of its source id's hash."""
    return completions.where(F.col("source") == source_id).agg(
        F.conv(F.substring(F.sha2(F.lit(source_id), 256), 1, 15), 16, 10).cast("bigint").alias("id"),
        F.lit(source_id).alias("source_id"),
        F.lit(filename).alias("filename"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit("quality_rating" in columns).alias("has_quality_rating"),
        F.lit("model" in columns).alias("has_model_column"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def dataset_id(filename: str, uploaded_at) -> str:
    """`upload_` and sixteen hex digits of the file name and the time of the upload.

    A replay of one upload has the same id; another upload of the same name has another.
    """
    return "upload_" + hashlib.sha256(f"{filename}|{uploaded_at}".encode()).hexdigest()[:16]


def next_id(table: DataFrame) -> int:
    """The first id after those in use; one number reaches the driver."""
    return table.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("next")).first()["next"]


def without_dataset(
    uploads: DataFrame, completions: DataFrame, evals: DataFrame, upload_id: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one dataset; an unknown id is an error.

    Rows without an id or a source belong to no dataset and stay.
    """
    found = uploads.where(F.col("id") == upload_id).select("source_id").head()
    if found is None:
        raise LookupError(f"no dataset {upload_id}")
    source = found["source_id"]
    doomed = completions.where(F.col("source") == source).select(F.col("id").alias("_doomed"))
    return (
        uploads.where(F.coalesce(F.col("id") != upload_id, F.lit(True))),
        completions.where(F.coalesce(F.col("source") != F.lit(source), F.lit(True))),
        evals.join(doomed, evals["completion_id"] == doomed["_doomed"], "left_anti"),
    )


def write_version(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write tables into a new version folder and return it."""
    target = f"{root}/{version}"
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{target}/{name}")
    return target


def refresh_daily(completions: DataFrame, path: str, days: Sequence[str] | None = None) -> None:
    """Recompute the daily model view; with `days`, only those partitions are replaced."""
    if days:
        touched = [F.lit(day).cast("date") for day in days]
        completions = completions.where(F.to_date("timestamp").isin(*touched))
    (
        rollups.model_daily_performance(completions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def record_evals(rows: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Append scores from outside that keep the contract; returns the others with reasons."""
    valid, rejected = split_valid(rows, eval_rules())
    append_evals(valid, path, batch_id)
    return rejected


def split_by_age(df: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows from before the cutoff day, and the rows to keep."""
    old = F.to_date("timestamp") < F.lit(cutoff).cast("date")
    return df.where(old), df.where(~F.coalesce(old, F.lit(False)))


def retire(df: DataFrame, cutoff, archive: str, kept: str) -> None:
    """Write old rows to the archive, then the kept rows to a new version."""
    old, recent = split_by_age(df, cutoff)
    old.write.mode("errorifexists").parquet(archive)
    recent.write.mode("errorifexists").parquet(kept)


def reload_all(battles: DataFrame, benchmark: DataFrame, root: str, anchor) -> None:
    """Drop all stored tables and load both sources; benchmark ids follow the arena's."""
    for name in ("completions", "evals", "uploads"):
        discard(battles.sparkSession, f"{root}/{name}")
    load_battles(battles, root, anchor)
    first = next_id(battles.sparkSession.read.parquet(f"{root}/completions"))
    load_benchmark(benchmark, root, anchor, first_id=first)
