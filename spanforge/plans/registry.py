"""All named queries, with their SQL where it can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("data_queries", "memory_queries", "trajectory_queries")
FLAGSHIP = "tk1_search"


def _parts() -> list:
    return [importlib.import_module(f"spanforge.plans.{m}") for m in MODULES]


def all_queries() -> dict[str, Query]:
    return {k: q for m in _parts() for k, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: q for m in _parts() for k, q in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return all_queries()[FLAGSHIP](spark, folder)
