"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.catalog.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Views` as a query; without `sql` only its rows are checked."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(df: DataFrame, **decimals: int) -> DataFrame:
    """Round columns whose last digits depend on the order of a floating-point sum."""
    return df.selectExpr(
        *[f"round(`{c}`, {decimals[c]}) AS `{c}`" if c in decimals else f"`{c}`" for c in df.columns]
    )
