"""All registered queries over the driver tables, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("score_plans", "series_plans", "evidence_plans", "source_plans", "claim_plans", "record_plans", "reserve_plans", "receipt_plans", "executor_plans", "corpus_plans", "text_plans", "verdict_plans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"refspark.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"refspark.plans.{m}").SQL.items()}
