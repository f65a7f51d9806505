"""All registered queries of the engine and the SQL that checks each of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("cohorts", "relational", "aggregates", "features", "dataflows", "naming", "facts", "storage", "search", "details", "boosts", "webpages", "flows", "careers")


def _modules():
    return [importlib.import_module(f"orderloom.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE
    return out
