"""Structured Streaming jobs over completions and scores.

Event time is a TIMESTAMP, as watermarks need one; results go back to wall-clock time. Aggregates
fold rows before the shuffle, so a hot model costs one partial row per task; sessions are merged per
task first where the session's settings ask for it, as those of `build_session` do. State is bounded
by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from calltally import schemas
from calltally.functions import numbers
from calltally.operators import alerts
from calltally.operators.quality import completion_rules, with_reasons
from calltally.operators.rollups import threshold_alerts

LATENESS = "1 hour"


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Calls as they land as JSON lines; unreadable fields become null and fail the contract."""
    reader = spark.readStream.schema(schemas.COMPLETIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def read_parquet_stream(spark: SparkSession, path: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def event_time(df: DataFrame, column: str = "timestamp", lateness: str = LATENESS) -> DataFrame:
    return df.withColumn("ts", F.col(column).cast("timestamp")).withWatermark("ts", lateness)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there, into Parquet files, and stop."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest(calls: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Split calls by contract into two tables.

    Each micro-batch overwrites its own batch folder, so a batch that runs again leaves the
    tables as they were.
    """
    judged = with_reasons(calls, completion_rules())

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid = F.size("reasons") == 0
            _replace(batch.where(valid).drop("reasons"), accepted, batch_id)
            _replace(batch.where(~valid), rejected, batch_id)
        finally:
            batch.unpersist()

    return (
        judged.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly_rollup(calls: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Closed hours per model.

    The quantiles are estimates, as their names say: the rank of each is off by at most one
    ten-thousandth of the group's rows, at every size. `metrics.by_hour` gives exact ones.
    """
    grouped = (
        event_time(calls, lateness=lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("latency_ms").alias("latency"),
            F.percentile_approx("latency_ms", [0.5, 0.95], 10_000).alias("q"),
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
            F.count(F.when(F.col("tokens_out") > 0, 1)).alias("success_count"),
        )
    )
    return grouped.select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"),
        "model",
        "requests",
        F.round("latency", 2).alias("avg_latency_ms"),
        F.round(F.col("q")[0], 2).alias("p50_approx"),
        F.round(F.col("q")[1], 2).alias("p95_approx"),
        numbers.usd(F.col("cost")).alias("total_cost_usd"),
        "success_count",
    )


def distinct_conversations(calls: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first call of every conversation within the watermark."""
    return event_time(calls, lateness=lateness).dropDuplicatesWithinWatermark(["conversation_id"])


def sliding_alerts(
    calls: DataFrame,
    max_latency_ms: float,
    max_error_percent: float,
    width: str = "1 hour",
    slide: str = "15 minutes",
    lateness: str = LATENESS,
) -> DataFrame:
    """Closed sliding windows per model whose mean latency or error rate is too high."""
    grouped = (
        event_time(calls, lateness=lateness)
        .groupBy(F.window("ts", width, slide).alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
            F.count(F.when(F.col("tokens_out") <= 0, 1)).alias("errors"),
        )
    )
    rate = numbers.percent(F.col("errors"), F.col("requests"), 0.0)
    rows = grouped.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "model",
        "requests",
        "avg_latency_ms",
        rate.alias("error_rate_percent"),
    )
    return rows.where(
        (F.col("avg_latency_ms") > max_latency_ms) | (F.col("error_rate_percent") > max_error_percent)
    )


def crossings(
    calls: DataFrame, rules: list[tuple[str, str, str, float, str]], width: str = "1 hour", slide: str = "15 minutes",
    lateness: str = LATENESS,
) -> DataFrame:
    """Rows of `rollups.threshold_alerts` for closed sliding windows; metrics are latency, error rate and requests."""
    grouped = (
        event_time(calls, lateness=lateness)
        .groupBy(F.window("ts", width, slide).alias("w"), "model")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.round(F.avg("latency_ms"), 2).alias("latency"),
            F.count(F.when(F.col("tokens_out") <= 0, 1)).alias("errors"),
        )
    )
    metrics = F.array(*[
        F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("metric_value"))
        for name, value in (
            ("latency_ms", F.col("latency")), ("request_count", F.col("requests")),
            ("error_rate_percent", numbers.percent(F.col("errors"), F.col("requests"), 0.0)),
        )
    ])
    rows = grouped.select("model", F.col("w.end").alias("window_end"), F.explode(metrics).alias("m"))
    return threshold_alerts(rows.select("model", "window_end", "m.*"), rules)


class _Follow(StatefulProcessor):
    """One open alert per key: facts, opened, last, windows, value, peak."""

    def __init__(self, quiet: timedelta, longest: timedelta | None) -> None:
        self._quiet, self._longest = quiet, longest
        self._facts = [c.split()[0] for c in alerts.FACTS.split(", ")]
        self._columns = [c.split()[0] for c in alerts.EVENTS.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        kinds = f"{alerts.FACTS}, opened timestamp, last timestamp, windows long, value double, peak double"
        self._open = handle.getValueState("open", kinds)

    def _end(self, held: list) -> pd.Timestamp:
        least = held[6] + self._quiet
        return min(least, held[5] + self._longest) if self._longest else least

    def _told(self, key: tuple, event: str, held: list) -> tuple:
        resolved = self._end(held) if event == "resolved" else None
        return (*key, *held[:5], event, held[5], resolved, *held[7:])

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self._columns)

    def _due(self, held: list) -> int:
        return int(self._end(held).timestamp() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        held = list(self._open.get()) if self._open.exists() else None
        if held:
            self._handle.deleteTimer(self._due(held))
        for row in pd.concat(list(rows)).sort_values("triggered_at", kind="stable").itertuples(index=False):
            at, value = row.triggered_at, float(row.metric_value)
            if held and at >= alerts.deadline(held[5], held[6], self._quiet, self._longest, at):
                out.append(self._told(key, "resolved", held))
                held = None
            if held:
                sign = ">" if ">" in held[2] else "<"
                held[6:] = [at, held[7] + 1, held[8], alerts.further(sign, held[9], value)]
            else:
                held = [*(getattr(row, f) for f in self._facts), at, at, 1, value, value]
                out.append(self._told(key, "opened", held))
        if self._due(held) < timerValues.getCurrentWatermarkInMs():
            out.append(self._told(key, "resolved", held))
            self._open.clear()
        else:
            if held[7] > 1:
                out.append(self._told(key, "updated", held))
            self._open.update(tuple(held))
            self._handle.registerTimer(self._due(held))
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self._open.get()) if self._open.exists() else None
        if held and self._due(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self._open.clear()
            yield from self._frames([self._told(key, "resolved", held)])

    def close(self) -> None:
        pass


def alert_lifecycle(
    crossed: DataFrame, quiet: timedelta = timedelta(minutes=30), longest: timedelta | None = None
) -> DataFrame:
    """Events of alerts, `opened`, `updated` and `resolved`, from a stream of crossings; see `operators.alerts`.

    State is one small row for each open alert and goes when it resolves, by a crossing that comes too
    late for it or by a timer in event time, so silence resolves alerts as well. Crossings of one key
    come in order from batch to batch, as windows close with the watermark; within a batch they are
    sorted. A batch that runs again gives the same events. The session's state store must be RocksDB
    (`with_timers`).
    """
    return crossed.groupBy(*alerts.KEY).transformWithStateInPandas(
        _Follow(quiet, longest), outputStructType=alerts.EVENTS, outputMode="append", timeMode="EventTime"
    )


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def user_sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per user; runs on a stream with event time and on a table alike.

    On a table, calls within one slot of the gap's length are folded first, as they share a session:
    what meets per user then grows with time, not with calls.
    """
    calls = calls.where(F.col("user_id").isNotNull())
    if not calls.isStreaming:
        return _sessions_of_table(calls, gap)
    grouped = (
        calls.groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            numbers.usd_total(F.col("cost_usd")).alias("cost"),
        )
    )
    return grouped.select(
        "user_id",
        F.col("s.start").cast("timestamp_ntz").alias("session_start"),
        F.col("s.end").cast("timestamp_ntz").alias("session_end"),
        "requests",
        numbers.usd(F.col("cost")).alias("total_cost_usd"),
    )


def _sessions_of_table(calls: DataFrame, gap: str) -> DataFrame:
    pause = F.expr(f"INTERVAL {gap}")
    slots = calls.groupBy("user_id", F.window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"),
        numbers.usd_total(F.col("cost_usd")).alias("cost"),
    )
    along = Window.partitionBy("user_id").orderBy("first")
    before = F.lag("last").over(along)
    opens = F.when(before.isNull() | (F.col("first") >= before + pause), 1).otherwise(0)
    placed = slots.withColumn("opens", opens).withColumn(
        "place", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    return placed.groupBy("user_id", "place").agg(
        F.min("first").cast("timestamp_ntz").alias("session_start"),
        (F.max("last") + pause).cast("timestamp_ntz").alias("session_end"),
        F.sum("n").alias("requests"),
        numbers.usd(F.sum("cost")).alias("total_cost_usd"),
    ).drop("place")


def scores_in_time(
    calls: DataFrame, evals: DataFrame, within: str = "1 hour", lateness: str = LATENESS
) -> DataFrame:
    """Scores that arrive within a time after their completion, joined on the completion id."""
    left = event_time(calls, "timestamp", lateness).select(
        F.col("id").alias("_id"), "model", F.col("ts").alias("_called")
    )
    right = event_time(evals, "created_at", lateness).select(
        "completion_id", "eval_type", "score", F.col("ts").alias("_scored")
    )
    joined = left.join(
        right,
        (F.col("_id") == F.col("completion_id"))
        & (F.col("_scored") >= F.col("_called"))
        & (F.col("_scored") <= F.col("_called") + F.expr(f"INTERVAL {within}")),
    )
    return joined.select("completion_id", "model", "eval_type", "score")


def split_late(
    calls: DataFrame, on_time: str, late: str, progress: str, checkpoint: str, lateness_s: int = 3600
) -> StreamingQuery:
    """Keep rows older than the newest earlier event minus the allowed lateness in a late table.

    The newest event time of every micro-batch is stored under its batch id, so a batch that runs
    again compares with the same boundary.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        boundary = None
        if batch_id > 0:
            stored = spark.read.schema("newest timestamp_ntz, batch_id bigint").parquet(progress)
            seen = stored.where(F.col("batch_id") < batch_id)
            boundary = seen.agg(F.max("newest").alias("newest")).head()["newest"]
        batch.persist()
        try:
            newest = batch.agg(F.max("timestamp").alias("newest")).where(
                F.col("newest").isNotNull()
            )
            _replace(newest, progress, batch_id)
            is_late: Column = F.lit(False)
            if boundary is not None:
                limit = F.lit(boundary) - F.make_dt_interval(secs=F.lit(lateness_s))
                is_late = F.coalesce(F.col("timestamp") < limit, F.lit(False))
            _replace(batch.where(~is_late), on_time, batch_id)
            _replace(batch.where(is_late), late, batch_id)
        finally:
            batch.unpersist()

    return (
        calls.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder, over whatever an earlier attempt left there."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def late_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table name."""
    result = None
    for name, table in tables.items():
        part = table.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("rows"))
        result = part if result is None else result.unionByName(part)
    return result
