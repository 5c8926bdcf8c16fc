"""Scoping, listing, paging and sampling of completions and scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally.functions import text, times

PAGE_LIMIT = 200


def _instant(value) -> Column:
    """A parameter as wall-clock time; a malformed text is an error, as parameters must be valid."""
    if not isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return F.coalesce(
        times.wall_clock(F.lit(value)),
        F.raise_error(F.lit(f"not an ISO-8601 time: {value}")).cast("timestamp_ntz"),
    )


def in_period(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Keep start <= column <= end; None leaves that side open."""
    if start is not None:
        df = df.where(F.col(column) >= _instant(start))
    if end is not None:
        df = df.where(F.col(column) <= _instant(end))
    return df


def last_days(df: DataFrame, anchor, days: int = 7, column: str = "timestamp") -> DataFrame:
    """Rows of the days up to and including `anchor`."""
    at = _instant(anchor)
    start = at - F.make_dt_interval(days=F.lit(days))
    return df.where((F.col(column) >= start) & (F.col(column) <= at))


def scoped(
    df: DataFrame,
    start=None,
    end=None,
    source: str | None = None,
    model: str | None = None,
    models: Iterable[str] | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """All optional scopes of a query; an empty value means no restriction."""
    if source:
        df = df.where(F.col("source") == source)
    if model:
        df = df.where(F.col("model") == model)
    if models:
        df = df.where(F.col("model").isin(*models))
    if user_id:
        df = df.where(F.col("user_id") == user_id)
    return in_period(df, start, end)


def by_id(df: DataFrame, row_id: int) -> DataFrame:
    """The row with this id, or no row."""
    return df.where(F.col("id") == row_id)


def log_rows(df: DataFrame) -> DataFrame:
    """Listing form of completions: long texts cut, time as ISO text."""
    return df.select(
        "id",
        text.cut(F.col("prompt")).alias("prompt"),
        text.cut(F.col("response")).alias("response"),
        "model",
        "tokens_in",
        "tokens_out",
        "latency_ms",
        "cost_usd",
        "user_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def newest_first(df: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One page of completions; only offset + limit rows ever leave a task."""
    if page < 1 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError("page starts at 1 and limit lies between 1 and 200")
    ordered = df.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return ordered.offset((page - 1) * limit).limit(limit)


def next_page(df: DataFrame, last_time, last_id: int, limit: int = 50) -> DataFrame:
    """The page after a given row; the cost does not grow with the depth of the page."""
    at = _instant(last_time)
    older = (F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") < last_id))
    return df.where(older).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def page_count(df: DataFrame, limit: int = 50) -> DataFrame:
    """Total rows and the number of pages, at least one."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("bigint").alias("pages")
    )


def eval_rows(
    evals: DataFrame,
    eval_type: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Scores in a range, by id, one page at a time."""
    if eval_type:
        evals = evals.where(F.col("eval_type") == eval_type)
    if min_score is not None:
        evals = evals.where(F.col("score") >= min_score)
    if max_score is not None:
        evals = evals.where(F.col("score") <= max_score)
    return evals.orderBy("id").offset(offset).limit(limit)


def first_items(df: DataFrame, limit: int) -> DataFrame:
    """The first work items by id."""
    return df.orderBy("id").limit(limit)


def with_attribute(df: DataFrame, document: str, path: str, value, kind: str) -> DataFrame:
    """Rows whose JSON document holds `value` at `path`; broken JSON never matches."""
    found = F.try_variant_get(F.try_parse_json(F.col(document)), path, kind)
    return df.where(found == F.lit(value))


def _cut(slots: DataFrame, slot: str, size: Column) -> Column:
    """The slot in which the `size`-th row falls, and how many of its rows are still wanted.

    `size` may use `_total`, the rows of all slots. The list of slots is bounded by the slot number.
    """
    listed = slots.groupBy(F.col(slot).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_slots"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(-1).alias("slot"), zero.alias("seen"), zero.alias("rest"))

    def step(state: Column, entry: Column) -> Column:
        moved = F.struct(
            entry["_at"].alias("slot"),
            (state["seen"] + entry["_n"]).alias("seen"),
            (F.col("_size") - state["seen"]).alias("rest"),
        )
        return F.when(state["seen"] >= F.col("_size"), state).otherwise(moved)

    # One scalar for both numbers, so the histogram is computed once.
    return listed.withColumn("_size", size.cast("bigint")).select(F.aggregate("_slots", start, step)).scalar()


def sample_rows(df: DataFrame, share: float, seed: str = "0", id_column: str = "id") -> DataFrame:
    """Exactly max(1, int(rows * share)) rows, chosen by a seeded hash of the id.

    Ranking all rows would end in one task. A histogram over 4 096 hash slots finds the slot in
    which the cut falls, and a second one finds the place among 65 536 parts of that slot: rows below
    are taken whole, and only one part in 268 million is ranked.
    """
    if share >= 1.0:
        return df
    hashed = df.withColumn(
        "_hash", F.md5(F.concat(F.col(id_column).cast("string"), F.lit("|" + seed)))
    ).withColumns({
        "_slot": F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"),
        "_part": F.conv(F.substring("_hash", 4, 4), 16, 10).cast("int"),
    })
    outer = _cut(hashed, "_slot", F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(share))))
    in_slot = hashed.where(F.col("_slot") == outer["slot"])
    inner = _cut(in_slot, "_part", outer["rest"])
    whole = hashed.where(
        (F.col("_slot") < outer["slot"]) | ((F.col("_slot") == outer["slot"]) & (F.col("_part") < inner["slot"]))
    )
    ranked = in_slot.where(F.col("_part") == inner["slot"]).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_slot", "_part").orderBy("_hash", id_column))
    ).where(F.col("_rank") <= inner["rest"])
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))
