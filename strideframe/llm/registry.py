"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("near_vectors", "toxicity", "substring", "warc", "licences", "urls", "bytebpe", "quality", "decontaminate", "minhash", "mainhtml", "whitening", "ranked")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query ``(spark, folder) -> DataFrame``."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every operator and return queries and SQL."""
    for module in MODULES:
        import_module(f"strideframe.llm.{module}")
    return QUERIES, SQL
