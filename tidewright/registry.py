"""Collects the queries of the library; each plans module offers QUERIES and ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.plans import charting, ensemble, fields, grid, packages, passage, planning, scalars, voyage

Query = Callable[[SparkSession, str], DataFrame]

MODULES: list = [ensemble, scalars, grid, voyage, passage, packages, planning, charting, fields]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
