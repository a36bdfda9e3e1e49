"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from opsloom.session import TABLES, load_tables


class Tables:
    """Tables of one data folder, and stand-in inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables = load_tables(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._tables[name]

    def derive(self, sql: str, **frames: DataFrame) -> DataFrame:
        """Run portable SQL text over the tables or frames named in braces."""
        used = {name: self._tables[name] for name in TABLES if "{" + name + "}" in sql}
        return self.spark.sql(sql, **used, **frames)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB text it must agree with."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def plain(sql: str) -> str:
    """Stand-in text with table names in place of the braces, for DuckDB."""
    return sql.replace("{", "").replace("}", "")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(run):
        return lambda spark, folder: run(Tables(spark, folder))

    return {name: bind(q.run) for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}


def _load() -> None:
    from opsloom.catalogue import (  # noqa: F401
        catalog, console, crm, diagnosis, inbox, quality, retrieval, sources, streams,
        text, usage,
    )
