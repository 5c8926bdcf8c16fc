"""File scans and exports: uploaded, battle and benchmark CSV, undelivered payloads, slices."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from calltally import schemas
from calltally.functions import text

UPLOAD_REQUIRED = ("prompt", "response")
BATTLE_REQUIRED = ("model_a", "model_b")
# What a battle file without the column means.
BATTLE_DEFAULTS = {"winner": "tie", "language": "English"}


def _csv(spark: SparkSession, multi_line: bool):
    """With line ends inside quoted cells a file cannot be split and is read by one task; many
    files are read in parallel, and files without such cells are split as usual."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def _headers(spark: SparkSession, path: str, multi_line: bool) -> dict[str, list[str]]:
    """Files of a path by their header line, from one pass over the lines.

    A file that is read line by line must not have a line end within quotes: its lines would be read
    as rows. Such a line has an odd number of quotes.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # the first line of a file lies in one task, which meets it before the file's others
    found = lines.groupBy("file").agg(
        F.first(F.when(F.col("start") == 0, F.col("value")), ignorenulls=True).alias("header"),
        F.count(F.when(odd, 1)).alias("open"),
    ).collect()
    if not multi_line and any(row["open"] for row in found):
        raise ValueError("a cell holds a line end: read the file with multi_line=True")
    by_header: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda row: row["file"]):
        by_header.setdefault(row["header"] or "", []).append(row["file"])
    return by_header


def _names(header: str) -> list[str]:
    cells = next(csv.reader([header.rstrip("\r")]), [])
    names = [name.lstrip("\ufeff").strip().lower() for name in cells]
    if len(set(names)) < len(names):
        raise ValueError("a column is named twice: " + ", ".join(names))
    return names


def _quoted(names: Sequence[str]) -> list[str]:
    """The names for `select`, where a dot in a header cell is no field access."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with their place in file order: files by path, blocks by start, rows as they are read.

    The numbers are dense and the same however the files are split: a split's rows follow each other
    in one task, so a row's place within its split is known there, and the splits' counts (one row
    per split) give the rest.
    """
    placed = rows.withColumns({
        "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
        "_at": F.monotonically_increasing_id(),
    })
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(offsets.drop("_n"), ["_file", "_start"]).select(
        *_quoted(rows.columns), (F.col("_before") + F.col("_at") - F.col("_first")).cast("bigint").alias(name)
    )


def _read_by_name(
    spark: SparkSession, path: str, multi_line: bool, required: Sequence[str], known: StructType | None, seq: str,
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of all files of a path, columns by the name in each file's own header.

    Names are stripped, lower-cased and free of a byte-order mark. With `known`, its columns are kept
    in its order and types; else all columns, as text. A column that a file lacks has its default
    there, else null; a file without a required column is an error.
    """
    parts, kinds = None, {f.name: f.dataType for f in known} if known else {}
    by_header = _headers(spark, path, multi_line)
    for header, found in by_header.items():
        names = _names(header)
        missing = [name for name in required if name not in names]
        if missing:
            raise ValueError("missing required column(s): " + ", ".join(missing))
        schema = StructType([StructField(name, kinds.get(name, StringType()), True) for name in names])
        rows = _csv(spark, multi_line).schema(schema).csv(path if len(by_header) == 1 else found)
        lacking = {name: F.lit(value) for name, value in (defaults or {}).items() if name not in names}
        part = rows.select(*_quoted(names), "_metadata").withColumns(lacking)
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    if parts is None:
        raise ValueError("the file has no data rows")
    kept = [f.name for f in known] if known else [c for c in parts.columns if c != "_metadata"]
    held = parts.select(*[
        F.col(cell) if name in parts.columns else F.lit(None).cast(kinds[name]).alias(name)
        for name, cell in zip(kept, _quoted(kept), strict=True)
    ], "_metadata")
    return _numbered(held, seq).select(*_quoted(kept), seq)


def read_upload_csv(
    spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Rows of an uploaded dataset as text columns with `_seq`, the row order.

    A missing required column or a file without rows is an error. `limit` keeps the first rows.
    """
    rows = _read_by_name(spark, path, multi_line, UPLOAD_REQUIRED, None, "_seq")
    if limit is not None:
        rows = rows.where(F.col("_seq") < limit)
    if rows.isEmpty():
        raise ValueError("the file has no data rows")
    return rows.fillna("")  # `_seq` is a number


def upload_features(columns: list[str]) -> dict[str, bool]:
    return {
        "has_quality_rating": "quality_rating" in columns,
        "has_model_column": "model" in columns,
    }


def read_battles_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Battles with `seq`, the row order; `rows` keeps the first ones only.

    A file without a winner column holds ties, one without a language column English texts. Cells
    hold no line ends, so large files are split.
    """
    battles = _read_by_name(spark, path, False, BATTLE_REQUIRED, schemas.BATTLES, "seq", BATTLE_DEFAULTS)
    return battles if rows is None else battles.where(F.col("seq") < rows)


def read_benchmark_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _read_by_name(spark, path, multi_line, UPLOAD_REQUIRED, schemas.BENCHMARK_ROWS, "seq")


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def undelivered_line(path: str, payload: Column, ts: Column) -> Column:
    """One JSON line of the client's fallback log."""
    return F.to_json(F.struct(F.lit(path).alias("path"), payload.alias("payload"), ts.alias("ts")))


def replay_undelivered(spark: SparkSession, path: str) -> DataFrame:
    """Calls from fallback logs: one per object payload, one per item of an array payload.

    A line that is not JSON gives nothing.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("line"))
    to_batch = F.try_variant_get("line", "$.path", "string").like("%/batch")
    items = F.when(
        to_batch, F.try_variant_get("line", "$.payload", "array<variant>")
    ).otherwise(F.array(F.try_variant_get("line", "$.payload", "variant")))
    calls = lines.select(
        F.try_variant_get("line", "$.ts", "string").alias("logged_at"),
        F.explode(F.filter(items, lambda item: item.isNotNull())).alias("call"),
    )
    return calls.select(
        "logged_at",
        *[
            F.try_variant_get("call", f"$.{field.name}", field.dataType.simpleString()).alias(
                field.name
            )
            for field in schemas.CALL_PAYLOAD
        ],
    )


def usable_rows(rows: DataFrame) -> DataFrame:
    """Upload rows with text on both sides; none at all is an error."""
    kept = rows.where(~text.is_blank(F.col("prompt")) & ~text.is_blank(F.col("response")))
    if kept.isEmpty():
        raise ValueError("no row has both a prompt and a response")
    return kept
