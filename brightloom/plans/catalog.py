"""Every registered query of the engine, by name, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.plans import application_queries, composite_queries, feed_queries, identity_queries, landed_queries, posting_queries

MODULES: list = [posting_queries, identity_queries, application_queries, feed_queries, composite_queries, landed_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
