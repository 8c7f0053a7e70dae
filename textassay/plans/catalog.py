"""Every named query with its SQL oracle, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import eval_queries, log_queries, model_queries, monitor_queries, ops_queries, signal_queries, study_queries, text_queries, verify_queries

MODULES = (text_queries, eval_queries, verify_queries, ops_queries, signal_queries, monitor_queries, model_queries, log_queries, study_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.query.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["text_signals"](spark, sf_dir)
