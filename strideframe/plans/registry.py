"""Registry of the verified queries: a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy readers of one data folder; each table is one DataFrame per query, though a plan may scan it more than once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that a plan uses more than once, made at its first use."""
        if name not in self.__dict__:
            self.__dict__[name] = make()
        return self.__dict__[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier")

    @cached_property
    def nation(self) -> DataFrame:
        return self.read("nation")

    @cached_property
    def region(self) -> DataFrame:
        return self.read("region")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
_MODULES = (
    "q_load",
    "q_sources",
    "q_streams",
    "q_frames",
    "q_vectors",
    "q_scalar",
    "q_catalog",
    "q_evaluation",
    "q_sensor",
    "q_labels",
    "q_relational",
)


def query(name: str, sql: str | None = None):
    """Register a plan under an operator id."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, plan, sql)
        return plan

    return add


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from importlib import import_module

    for module in _MODULES:
        import_module(f"strideframe.plans.{module}")
    return QUERIES
