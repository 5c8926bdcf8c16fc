"""Price and latency lookups by model name, with a default for unknown names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally import values


def _lookup(model: Column, table: dict[str, tuple], default: tuple, position: int) -> Column:
    """A dictionary this small is a literal map: no join and no broadcast job."""
    entries = ", ".join(f"'{name}', {float(pair[position])}D" for name, pair in table.items())
    found = F.try_element_at(F.expr(f"map({entries})"), F.lower(model))
    return F.coalesce(found, F.lit(float(default[position])))


def cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    price_in = _lookup(model, values.MODEL_PRICES, values.DEFAULT_PRICE, 0)
    price_out = _lookup(model, values.MODEL_PRICES, values.DEFAULT_PRICE, 1)
    return F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 8)


def latency_low(model: Column) -> Column:
    return _lookup(model, values.LATENCY_RANGES, values.DEFAULT_LATENCY_RANGE, 0)


def latency_high(model: Column) -> Column:
    return _lookup(model, values.LATENCY_RANGES, values.DEFAULT_LATENCY_RANGE, 1)


def _table(spark: SparkSession, table: dict[str, tuple], columns: str) -> DataFrame:
    """A literal relation: its size is known to the planner, which then broadcasts it."""
    rows = ", ".join(f"('{n}', {float(a)}D, {float(b)}D)" for n, (a, b) in table.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def price_table(spark: SparkSession) -> DataFrame:
    return _table(spark, values.MODEL_PRICES, "model, price_in, price_out")


def latency_table(spark: SparkSession) -> DataFrame:
    return _table(spark, values.LATENCY_RANGES, "model, latency_low, latency_high")


def with_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach prices from a table; unknown models get the default.

    No broadcast hint: the planner broadcasts the table only below its own size threshold.
    """
    default_in, default_out = values.DEFAULT_PRICE
    named = prices.select(
        F.lower("model").alias("_model"), F.col("price_in"), F.col("price_out")
    )
    return (
        calls.join(named, F.lower(calls["model"]) == named["_model"], "left")
        .withColumn("price_in", F.coalesce("price_in", F.lit(default_in)))
        .withColumn("price_out", F.coalesce("price_out", F.lit(default_out)))
        .drop("_model")
    )
