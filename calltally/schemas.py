"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _I, _D = StringType(), LongType(), IntegerType(), DoubleType()
_B, _T = BooleanType(), TimestampNTZType()

COMPLETIONS = _schema(
    id=_L, timestamp=_T, prompt=_S, response=_S, model=_S, tokens_in=_I, tokens_out=_I,
    latency_ms=_D, cost_usd=_D, user_id=_S, conversation_id=_S, source=_S,
)
EVALS = _schema(
    id=_L, completion_id=_L, eval_type=_S, score=_D, criteria=_S, explanation=_S,
    created_at=_T, source=_S,
)
UPLOADS = _schema(
    id=_L, source_id=_S, filename=_S, row_count=_L, has_quality_rating=_B,
    has_model_column=_B, created_at=_T,
)
BATTLES = _schema(
    conversation_id=_S, model_a=_S, model_b=_S, winner=_S, language=_S, timestamp=_S,
    tokens_in=_I, tokens_out=_I, latency_ms=_D, cost_usd=_D,
)
BENCHMARK_ROWS = _schema(prompt=_S, response=_S, quality_rating=_S, criteria=_S, human_rater=_S)
METRICS = _schema(
    metric_name=_S, metric_type=_S, metric_value=_D, min_value=_D, max_value=_D, avg_value=_D,
    model=_S, window_start=_T, window_end=_T,
)
# Payload of one logged call; loose types so that a bad value becomes a rejection, not a failure.
CALL_PAYLOAD = _schema(
    prompt=_S, response=_S, model=_S, tokens_in=_D, tokens_out=_D, latency_ms=_D, cost_usd=_D,
    user_id=_S, conversation_id=_S,
)
