"""Structured Streaming versions of ingest, de-duplication, rollups and score joins."""
