"""Registered queries: each operator on the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civiltext.plans import cleaning, corpus, dedup, metrics, models, sampling

GROUPS = (corpus, cleaning, dedup, sampling, models, metrics)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
