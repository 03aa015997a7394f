"""Registered queries and their SQL twins."""

from coreline.catalog import carbon, elements, statistics, summaries  # noqa: F401
from coreline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
