"""Every query of the library's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialweave.plans import analysis_queries, extra_queries, model_queries, storage_queries, trial_queries  # noqa: F401  importing registers the queries


def entry(spark: SparkSession) -> DataFrame:
    """Window summaries of the smallest trial table."""
    return trial_queries.QUERIES["AGG04"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(trial_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(trial_queries.SQL)
