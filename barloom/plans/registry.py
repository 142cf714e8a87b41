"""All queries of the market operators."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.kit import Query

PARTS = ("technical", "ranks", "trust", "markets", "companies", "streams", "shapes", "lists", "reports", "valuations", "cohorts", "formations", "ledgers")


def _parts():
    return [import_module(f"barloom.plans.{name}").R for name in PARTS]


def queries() -> dict[str, Query]:
    return {k: v for part in _parts() for k, v in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _parts() for k, v in part.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of the latest cross-sectional ranking."""
    return queries()["rk26_rank_latest"](spark, sf_dir)
