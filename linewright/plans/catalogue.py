"""Imports every module that registers core queries."""

from linewright.plans import conversations, facts, history, indexing, line_classes, line_runs, sifting, streams, tokens  # noqa: F401
from linewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
