"""Imports every module that registers queries."""

from calltally.plans import loads, operations, scores, streams, texts, traffic, views
from calltally.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS", "loads", "operations", "scores", "streams", "texts", "traffic", "views"]
