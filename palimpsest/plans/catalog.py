"""Registry of queries, one module per operator family; each module has QUERIES and SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES: tuple[str, ...] = ("history", "scans", "merging", "references", "timelines", "exchange")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in FAMILIES for k, f in import_module(f"palimpsest.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in FAMILIES for k, q in import_module(f"palimpsest.plans.{m}").SQL.items()}
