"""Registered queries of the compliance engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.plans import assigned, compare, corpus, details, job, layout, packages, rules, spec, structure, tables  # noqa: F401  importing a module registers its queries
from quire.plans.registry import ORACLES, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_structure_score"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
