"""All queries of the core and their oracles, collected from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("core_problems", "speech", "terms", "archive", "output", "live", "settings")


def _modules() -> list:
    return [import_module(f"tidemark.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
