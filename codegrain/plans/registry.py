"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("lexing", "labels", "metrics", "curation", "numeric", "extra", "engines")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"codegrain.plans.{m}"), name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
