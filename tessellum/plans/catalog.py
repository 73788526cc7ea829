"""Registry of the queries over the project's tables. Each has the statement that DuckDB runs for comparison, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tessellum.sources.tables import table

#: The present, as a parameter: listings that look back from now stay reproducible.
NOW = datetime(2025, 6, 1)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    from tessellum.plans import aggregates, analytics, compatibility, components, filters, general, joins, listings, ordering, processing, review, scalars, sinks, text, windows  # noqa: F401
    from tessellum.streaming import incremental  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
