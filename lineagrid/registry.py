"""Queries and oracle SQL of the lineage library, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``plans`` that hold QUERIES and ORACLES.
MODULES: list[str] = ["graphs", "models", "diffs", "sources", "ingest", "jobs"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"lineagrid.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"lineagrid.plans.{m}").ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.graphs import flagship as run

    return run(spark, sf_dir)
