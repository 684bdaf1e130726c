"""Every query of the engine and its SQL twin, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("tape_plans", "read_plans", "coverage_plans", "replay_plans", "finance_plans", "source_plans", "quality_plans", "report_plans", "evidence_plans", "governance_plans", "settlement_plans", "metric_plans")


def plans() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"quillspar.plans.{name}").PLANS
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in plans().items() if sql}
