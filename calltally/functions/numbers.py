"""Number expressions: tolerant parsing, ratios, money sums and repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calltally.functions.text import strip


# Decimal and scientific notation; leaves out NaN, Infinity and type suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_float(text: Column, default: Column) -> Column:
    """Number in the text; blank, broken, NaN or infinite text gives the default."""
    plain = strip(text)
    number = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number).otherwise(default.cast("double"))


def parse_int(text: Column, default: Column) -> Column:
    """Number truncated towards zero; anything unusable gives the default."""
    number = parse_float(text, F.lit(None))
    return F.coalesce(number.try_cast("int"), default.cast("int"))


def clamp01(value: Column) -> Column:
    """Value moved into 0–1; a missing value stays missing."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)))


def percent(part: Column, whole: Column, empty: float = 100.0, digits: int = 2) -> Column:
    return F.round(
        F.when(whole == 0, F.lit(empty)).otherwise(part / F.nullif(whole, F.lit(0)) * 100), digits
    )


def rounded(value: Column, digits: int) -> Column:
    """Rounded value with 0 in place of a missing one."""
    return F.round(F.coalesce(value, F.lit(0.0)), digits)


# The same as SQL text over column names: a report of many columns is built in one call.
USD_TOTAL = "coalesce(sum(cast(cost_usd AS decimal(18,8))), cast(0 AS decimal(28,8)))"


def rounded_sql(name: str, digits: int, alias: str | None = None) -> str:
    return f"round(coalesce({name}, 0D), {digits}) AS {alias or name}"


def percent_sql(part: str, whole: str, alias: str, empty: float = 100.0, digits: int = 2) -> str:
    share = f"CASE WHEN {whole} = 0 THEN {empty}D ELSE {part} / {whole} * 100 END"
    return f"round({share}, {digits}) AS {alias}"


def exact_usd(value: Column) -> Column:
    """Money to 8 digits, half up."""
    return value.cast("decimal(18,8)")


def usd_total(value: Column) -> Column:
    """Sum of money held as decimals, so that it does not depend on the order of addition."""
    return F.coalesce(F.sum(exact_usd(value)), F.lit(0).cast("decimal(28,8)"))


def usd(total: Column, digits: int = 6) -> Column:
    return F.round(total, digits).cast("double")


def usd_mean(total: Column, rows: Column, digits: int = 6) -> Column:
    """Mean of decimal money; decimal division keeps ties where they are."""
    mean = F.round(total / F.nullif(rows, F.lit(0)), digits).cast("double")
    return F.coalesce(mean, F.lit(0.0))


def draw(key: Column, salt: str, choices: int) -> Column:
    """A repeatable choice in [0, choices) that depends on the key alone."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(choices))


def draw_unit(key: Column, salt: str) -> Column:
    """A repeatable number in [0, 1) that depends on the key alone."""
    return draw(key, salt, 2**32) / F.lit(float(2**32))
