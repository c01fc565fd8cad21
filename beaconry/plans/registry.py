"""Registered queries: one per operator, each with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from beaconry.plans.shipping import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its oracle SQL."""

    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from beaconry.plans import queries_delivery, queries_enrich, queries_scan, queries_streams, queries_values  # noqa: F401

    return QUERIES, ORACLE
