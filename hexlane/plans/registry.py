"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import blocks, decisions, extras, features, learned, more, pages, parsing, relational, reports, searches, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, 120 outcomes, softmax, expected value, ranks and their summary."""
    return QUERIES["ev_summary"](spark, sf_dir)
