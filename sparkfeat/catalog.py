"""Registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Every query reads the driver tables (through the fixtures) and runs over
whole tables. Doubles that come from sums or divisions are rounded to 6
places on both sides; counts are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    # importing the modules fills REGISTRY
    from sparkfeat.plans import q_encode, q_clean, q_features, q_text, q_profile  # noqa: F401
    from sparkfeat.plans import q_sets, q_ensemble, q_models, q_stream, q_checks  # noqa: F401


def queries() -> dict:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
