"""The life of an alert: it opens once, stays open while windows keep crossing, and resolves when they stop.

An alert of one rule and model opens at the end of the first window that crosses, and stays open as
long as the next crossing window ends no later than `quiet` after the last one; windows without calls
count as quiet. It resolves `quiet` after the last crossing, or `longest` after it opened if that comes
first; the next crossing opens another. `streaming.jobs.alert_lifecycle` follows the same rules on a
stream, `plain_episodes` is what both must give.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("alert_name", "model")
FACTS = "alert_type string, severity string, triggered_condition string, threshold_value double, metric_name string"
EVENTS = (
    f"alert_name string, model string, {FACTS}, event string, triggered_at timestamp, resolved_at timestamp,"
    " windows long, metric_value double, peak_value double"
)


def further(sign: str, one: float, other: float) -> float:
    """Whichever value is further beyond the threshold of a rule with this comparison."""
    return max(one, other) if sign.startswith(">") else min(one, other)


def plain_episodes(
    crossings: list[tuple[datetime, float]], quiet: timedelta, longest: timedelta | None, until: datetime, sign: str = ">"
) -> list[tuple]:
    """(triggered_at, resolved_at or None, windows, value, peak) of one key, from (window end, value) in any order."""
    out: list[list] = []
    for at, value in sorted(crossings):
        if out and at < deadline(out[-1][0], out[-1][5], quiet, longest, at):
            episode = out[-1]
            episode[2:] = [episode[2] + 1, episode[3], further(sign, episode[4], value), at]
        else:
            out.append([at, None, 1, value, value, at])
    for episode in out:
        end = min(episode[5] + quiet, episode[0] + longest if longest else datetime.max)
        episode[1] = end if end < until or episode is not out[-1] else None
    return [tuple(e[:5]) for e in out]


def deadline(opened, last, quiet, longest, at):
    """First moment after which a crossing at `at` no longer belongs to the alert."""
    tick = timedelta(microseconds=1)
    ends = last + quiet + tick
    return min(ends, opened + longest) if longest else ends


def episodes(crossings: DataFrame, quiet: str = "30 minutes", until=None) -> DataFrame:
    """One row for each alert from rows of `rollups.threshold_alerts`.

    `until` is the time up to which windows are complete, the last crossing by default. Rows are one a
    window, rule and model, so what meets per key grows with time, not with calls.
    """
    pause = F.expr(f"INTERVAL {quiet}")
    along = Window.partitionBy(*KEY).orderBy("triggered_at")
    before = F.lag("triggered_at").over(along)
    opens = F.when(before.isNull() | (F.col("triggered_at") > before + pause), 1).otherwise(0)
    placed = crossings.withColumn("_opens", opens).withColumn(
        "_place", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    upward = F.instr("triggered_condition", ">") > 0
    facts = [c.split()[0] for c in FACTS.split(", ")]
    folded = placed.groupBy(*KEY, "_place").agg(
        *[F.first(c).alias(c) for c in facts],
        F.min("triggered_at").alias("opened"), F.max("triggered_at").alias("last"), F.count(F.lit(1)).alias("windows"),
        F.min_by("metric_value", "triggered_at").alias("metric_value"),
        F.max(F.when(upward, F.col("metric_value"))).alias("_high"), F.min(F.when(~upward, F.col("metric_value"))).alias("_low"),
    )
    known = F.lit(until).cast("timestamp_ntz") if until is not None else crossings.agg(F.max("triggered_at")).scalar()
    ends = F.col("last") + pause
    return folded.withColumn("resolved_at", F.when(ends < known, ends)).select(
        *KEY, *facts, F.col("opened").alias("triggered_at"), "resolved_at", "windows", "metric_value",
        F.coalesce("_high", "_low").alias("peak_value"),
        F.col("resolved_at").isNull().alias("is_active"), F.col("resolved_at").isNotNull().alias("is_resolved"),
    )


def standing(events: DataFrame) -> DataFrame:
    """The alert table from stored events: an alert is resolved if an event says so.

    The event with an end, else that over most windows, tells its state; a repeated event changes nothing.
    """
    facts = [c.split()[0] for c in FACTS.split(", ")]
    last = F.struct("resolved_at", "windows", "metric_value", "peak_value")
    folded = events.groupBy(*KEY, "triggered_at").agg(
        *[F.first(c).alias(c) for c in facts], F.max(last).alias("_last")  # null ends sort first
    )
    return folded.select(
        *KEY, *facts, "triggered_at", F.col("_last.resolved_at").alias("resolved_at"), "_last.windows", "_last.metric_value",
        "_last.peak_value", F.col("_last.resolved_at").isNull().alias("is_active"),
        F.col("_last.resolved_at").isNotNull().alias("is_resolved"),
    )
