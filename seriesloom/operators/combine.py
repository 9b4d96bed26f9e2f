"""Bringing several sources into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_value(value: Column, what: str) -> Column:
    """The one known value of a group; a second one is an error, not a choice."""
    several = F.raise_error(F.lit(f"several rows of one key hold a value of {what}: remove duplicates first"))
    return F.when(F.count(value) > 1, several).otherwise(F.max(value))


def join_sources(frames: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Full outer join of any number of tables with one row per key.

    Written as union and aggregate: with unique keys that is the same table, and it takes
    one shuffle for all sources where a chain of full joins takes one per source, each on
    the coalesced keys of the previous one. A column name found in several sources is taken
    from the first. The inputs must be unique by key (`tidy.dedupe_first`); two known values
    of one key are an error.
    """
    if not frames:
        raise ValueError("no source was selected")
    by = keys or ["series_id", "date"]
    taken: list[str] = []
    parts = []
    for frame in frames:
        own = [c for c in frame.columns if c not in by and c not in taken]
        taken += own
        parts.append(frame.select(*by, *own))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*by).agg(*[only_value(F.col(c), c).alias(c) for c in taken])


def long_to_wide(
    df: DataFrame,
    names: list[str],
    keys: list[str] | None = None,
    name: str = "variable",
    value: str = "value",
) -> DataFrame:
    """One column per name of a fixed list; the long table is unique by (keys, name), and two
    known values of one cell are an error."""
    by = keys or ["series_id", "date"]
    return df.groupBy(*by).agg(
        *[only_value(F.when(F.col(name) == n, F.col(value)), n).alias(n) for n in names]
    )


def wide_to_long(
    df: DataFrame, columns: list[str], keys: list[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def stack_parts(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def sum_parts(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Stack yearly parts and add up rows with equal keys."""
    return stack_parts(parts).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both tables have."""
    return left.select(*keys).intersect(right.select(*keys))


def share_by_date(panel: DataFrame, shared: DataFrame, date: str = "date") -> DataFrame:
    """Add variables that all series share to the panel.

    The shared table has one row per calendar day, a few thousand rows at any panel size;
    that bound is why it may be broadcast.
    """
    return panel.join(F.broadcast(shared), date, "left")


def align(
    left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Left table plus columns of the right one with equal keys; absent keys give NULL."""
    return left.join(right.select(*keys, *columns), keys, "left")
