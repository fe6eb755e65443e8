"""Registry of the document-evidence queries: each is an operator applied to the tables of a data folder, with DuckDB SQL
that must give the same rows where SQL can express it. Scores are compared as whole numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle."""

    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _ORACLES[function.__name__] = sql
        return function

    return register


def _load() -> None:
    from evidra.plans import answering, documents, evidence, layouts, responding, retrieving, scans  # noqa: F401  they register themselves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best passages for each benchmark question."""
    _load()
    return _QUERIES["best_passages"](spark, sf_dir)


def queries() -> dict[str, Query]:
    """Queries by name."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    _load()
    return dict(_ORACLES)
