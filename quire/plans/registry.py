"""Where queries are registered, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.views import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str, sql: str | None, more: str = ""):
    """Register a function of (spark, sf_dir); ``views`` are the fixture views that its SQL reads, ``more`` further CTEs."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [x for x in (ctes(tuple(views.split())) if views else "", more) if x]
            ORACLES[f.__name__] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql
        return f

    return of
