"""All queries of the model-evaluation operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import diagnosis_queries, evaluation_queries, fold_queries, leakage_queries, scope_queries

MODULES = (leakage_queries, diagnosis_queries, fold_queries, evaluation_queries, scope_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
