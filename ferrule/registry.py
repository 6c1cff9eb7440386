"""All named queries of the reference operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def wrap(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        key = name or f.__name__
        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return wrap


def load() -> None:
    """Import the modules that register queries."""
    from ferrule.plans import capability_queries, catalog_queries, doc_queries, document_queries, graph_queries, index_queries, log_queries, lookup_queries, privacy_queries, source_queries, store_queries, structure_queries, table_queries, trace_queries  # noqa: F401


load()
