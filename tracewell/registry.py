"""Every query of the library, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's id, with its SQL where SQL can express it."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries():
    from .plans import data_queries, identity_queries, index_queries, more_queries, port_queries, rule_queries, surface_queries  # noqa: F401 - they register themselves

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)
