"""Exact linear-interpolated quantiles by rank search, in one form for every size.

`percentile` keeps a value → count map per group in one task, which fails once a group has billions of
distinct values. Here no task holds a whole group:

1. one scan folds rows per group and coarse bucket of the value, with whatever else is aggregated;
   running counts over these buckets tell which of them holds each wanted rank;
2. a bucket that still holds many rows is divided further, by its own lowest and highest value;
3. a second scan counts the distinct values of just the buckets that are left, which gives the wanted
   order statistics.

Values are ordered as `percentile` orders them: NaN after infinity, nulls left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltally.session import cut_lineage

BUCKETS_PER_OCTAVE = 1024
# A bucket with more rows is divided into this many parts before its values are ranked.
HEAVY_ROWS = 1_000_000
PARTS = 4096
# Wanted buckets are broadcast up to this many bytes, their keys counted in full.
BROADCAST_BYTES = 8 << 20
TARGET_BYTES = 200  # of a wanted bucket besides its keys

# A merged aggregate: its name, the aggregate over rows, and how parts of it merge (sum, min or max).
Part = tuple[str, Column, str]


def _bucket(value: Column) -> Column:
    """A whole number that never falls while the value rises: about 0.07 % wide, 0 for zero.

    Infinities have the outermost buckets of the numbers, NaN the one above them.
    """
    infinite = 3000 * BUCKETS_PER_OCTAVE
    size = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + F.lit(1100 * BUCKETS_PER_OCTAVE)
    return (
        F.when(F.isnan(value), infinite + 1)
        .when(value == float("inf"), infinite)
        .when(value == float("-inf"), -infinite)
        .when(value > 0, size)
        .when(value < 0, -size)
        .when(value == 0, 0)
        .cast("bigint")
    )


def _position(share: float, total: Column) -> Column:
    return F.lit(share) * (total - 1)


def _ranks_within(ranks: Column, before: Column, rows: Column) -> Column:
    return F.filter(ranks, lambda rank: (rank >= before) & (rank < before + rows))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null keys meet; the key columns of `left` stay."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _matched(values: DataFrame, targets: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Rows (with `_n`, how often) whose value lies within a target of their key."""
    if small:
        rows, targets = values.withColumn("_n", F.lit(1).cast("bigint")), F.broadcast(targets)
    else:
        # Too many groups to broadcast: fold equal values before the join has to shuffle them.
        rows = values.groupBy(*keys, "_bucket", "_value").agg(F.count(F.lit(1)).alias("_n"))
    met = _joined(rows, targets.withColumnRenamed("_n", "_rows"), [*keys, "_bucket"], "inner")
    return met.where(F.col("_value").between(F.col("_low"), F.col("_high")))


def _divided(values: DataFrame, targets: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Targets cut into parts by value; only parts that hold a wanted rank stay."""
    share = (F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    part = F.least(F.lit(PARTS - 1), F.floor(share * PARTS))
    histogram = (
        _matched(values, targets, keys, small)
        .withColumn("_part", part)
        .groupBy(*keys, "_bucket", F.col("_low").alias("_from"), "_part")
        .agg(
            F.sum("_n").alias("_n"),
            F.min("_value").alias("_low"),
            F.max("_value").alias("_high"),
            F.first("_total").alias("_total"),
            F.first("_before").alias("_start"),
            F.first("_ranks").alias("_ranks"),
        )
    )
    along = Window.partitionBy(*keys, "_bucket", "_from").orderBy("_part")
    running = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return (
        histogram.withColumn("_before", F.col("_start") + running - F.col("_n"))
        .withColumn("_ranks", _ranks_within(F.col("_ranks"), F.col("_before"), F.col("_n")))
        .where(F.size("_ranks") > 0)
        .select(*targets.columns)
    )


def _valued(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    source = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    return source.withColumn("_value", F.col(value).cast("double")).withColumn("_bucket", _bucket(F.col("_value")))


def _folded(valued: DataFrame, keys: Sequence[str], parts: Sequence[Part]) -> DataFrame:
    """The first scan: per key and bucket the parts, the rows with a value, and its bounds."""
    return valued.groupBy(*keys, "_bucket").agg(
        *[part.alias(name) for name, part, _ in parts],
        F.count("_value").alias("_n"),
        F.min("_value").alias("_low"),
        F.max("_value").alias("_high"),
    )


def _merged(parts: Sequence[Part]) -> list[Column]:
    return [getattr(F, how)(name).alias(name) for name, _, how in parts]


def _ranked(
    valued: DataFrame, folded: DataFrame, keys: list[str], shares: Mapping[str, float],
    heavy_rows: int, broadcast_bytes: int,
) -> DataFrame:
    """Quantiles per key from the folded rows of the first scan and a second scan."""
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    positions = [_position(share, F.col("_total")) for share in shares.values()]
    wanted = F.array_distinct(F.array(*[end(p) for p in positions for end in (F.floor, F.ceil)]))
    targets = (
        folded.where(F.col("_bucket").isNotNull())
        .select(*keys, "_bucket", "_n", "_low", "_high")
        .withColumn("_total", F.sum("_n").over(per_key))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .withColumn("_ranks", _ranks_within(wanted, F.col("_before"), F.col("_n")))
        .where(F.size("_ranks") > 0)
        .select(*keys, "_bucket", "_n", "_low", "_high", "_total", "_before", "_ranks")
    )
    values = valued.where(F.col("_value").isNotNull()).select(*keys, "_bucket", "_value")
    heavy = (F.col("_n") > heavy_rows) & (F.col("_low") < F.col("_high"))
    held = F.octet_length(F.concat_ws("", *[F.col(k).cast("string") for k in keys]))
    while True:
        size = targets.agg(
            F.coalesce(F.sum(held + TARGET_BYTES), F.lit(0)).alias("bytes"), F.count(F.when(heavy, 1)).alias("heavy")
        ).first()
        small = size["bytes"] <= broadcast_bytes
        if size["heavy"] == 0:
            break
        # Every round narrows a bucket 4 096 times, so a few rounds end at single values.
        divided = _divided(values, targets.where(heavy), keys, small)
        targets = cut_lineage(targets.where(~heavy).unionByName(divided))
    in_target = Window.partitionBy(*keys, "_bucket", "_low").orderBy("_value")
    counted = (
        _matched(values, targets, keys, small)
        .groupBy(*keys, "_bucket", "_low", "_value")
        .agg(
            F.sum("_n").alias("_n"),
            F.first("_total").alias("_total"),
            F.first("_before").alias("_before"),
            F.first("_ranks").alias("_ranks"),
        )
        .withColumn(
            "_start",
            F.col("_before")
            + F.sum("_n").over(in_target.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_n"),
        )
        .withColumn(
            "_rank",
            F.explode(_ranks_within(F.col("_ranks"), F.col("_start"), F.col("_n"))),
        )
    )
    outputs = []
    for name, share in shares.items():
        position = _position(share, F.col("_total"))
        low = F.max(F.when(F.col("_rank") == F.floor(position), F.col("_value")))
        high = F.max(F.when(F.col("_rank") == F.ceil(position), F.col("_value")))
        part = _position(share, F.max("_total"))
        mixed = (F.ceil(part) - part) * low + (part - F.floor(part)) * high
        outputs.append(F.when(low == high, low).otherwise(mixed).alias(name))
    return counted.groupBy(*keys).agg(*outputs)


def ranked_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    heavy_rows: int = HEAVY_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact quantiles per key; one row per key that has any value."""
    named = list(keys) or ["_all"]
    valued = _valued(df, named, value)
    folded = cut_lineage(_folded(valued, named, []))
    return _ranked(valued, folded, named, shares, heavy_rows, broadcast_bytes).drop("_all")


def grouped_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    parts: Sequence[Part],
    value: str,
    shares: Mapping[str, float],
) -> DataFrame:
    """Merged `parts` and exact quantiles of `value` per key, from two scans of `df`."""
    named = list(keys) or ["_all"]
    valued = _valued(df, named, value)
    folded = cut_lineage(_folded(valued, named, parts))
    quantiles = _ranked(valued, folded, named, shares, HEAVY_ROWS, BROADCAST_BYTES)
    if keys:
        totals = folded.groupBy(*keys).agg(F.first("_bucket").alias("_any"), *_merged(parts)).drop("_any")
        return _joined(totals, quantiles, list(keys), "left")
    row = quantiles.select(F.struct(*shares)).scalar()
    totals = folded.agg(F.count(F.lit(1)).alias("_any"), *_merged(parts)).drop("_any").withColumn("_quantiles", row)
    return totals.select("*", *[F.col("_quantiles")[n].alias(n) for n in shares]).drop("_quantiles")


def rank_errors(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Per key and quantile of `approximate_quantiles`: rows, and whether its rank keeps the bound.

    The bound is rows / accuracy, and one row for the rounding of a rank.
    """
    named = [f"'{name}', {name}, {share}D" for name, share in shares.items()]
    estimates = approximate_quantiles(df, keys, value, shares, accuracy).select(
        *keys, F.expr(f"stack({len(named)}, {', '.join(named)}) AS (quantile, estimate, share)")
    )
    ranked = _joined(df.where(F.col(value).isNotNull()).select(*keys, value), estimates, keys, "inner")
    counted = ranked.groupBy(*keys, "quantile", "share").agg(
        F.count(F.lit(1)).alias("value_count"),
        F.count(F.when(F.col(value) < F.col("estimate"), 1)).alias("below"),
        F.count(F.when(F.col(value) <= F.col("estimate"), 1)).alias("up_to"),
    )
    wanted, bound = F.col("share") * F.col("value_count"), F.col("value_count") / accuracy + 1
    keeps = (F.col("below") <= wanted + bound) & (F.col("up_to") >= wanted - bound)
    return counted.select(*keys, "quantile", "value_count", keeps.alias("keeps_bound"))


def approximate_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Bounded-memory quantiles; the rank error is at most rows / accuracy."""
    listed = F.percentile_approx(value, [float(s) for s in shares.values()], accuracy)
    grouped = df.groupBy(*keys).agg(F.count(value).alias("value_count"), listed.alias("_quantiles"))
    for at, name in enumerate(shares):
        grouped = grouped.withColumn(name, F.col("_quantiles")[at])
    return grouped.drop("_quantiles")
