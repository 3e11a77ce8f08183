"""All queries of the library's own operators, with the SQL each is checked against.

A query module calls ``query(name, sql)`` on a function of (spark, sf_dir). Queries without SQL are covered by tests.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("pages", "urls", "texts", "evaluation", "policies", "crawl", "documents", "records", "gates", "bodies", "studies", "graph", "outputs")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is defined twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"brookmill.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
