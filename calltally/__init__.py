"""Spark jobs over model-call telemetry: completions, scores, rollups and alerts."""
