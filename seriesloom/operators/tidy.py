"""Row selection, cleaning and inspection of panel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numbers import safe_ratio, within
from seriesloom.operators.calendar import day
from seriesloom.settings import DOMAIN_BOUNDS


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first record of every key by `order`.

    An aggregate, not a ranked window: the earliest record is found on the map side, so a
    key with very many copies sends one record per task.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in rest], F.min(order).alias(order)
    )


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before, rows kept and rows removed by `dedupe_first`."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.sum("n") - F.count(F.lit(1))).alias("rows_removed"),
    )


def last_known_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Last value that is not missing, by `order` (later columns break ties)."""
    known = F.when(F.col(value).isNotNull(), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return df.groupBy(*keys).agg(F.max_by(value, known).alias(value))


def date_slice(df: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Inclusive range of dates; either end may be open."""
    out = df
    if start is not None:
        out = out.where(F.col(date) >= day(start))
    if end is not None:
        out = out.where(F.col(date) <= day(end))
    return out


def domain_bounds(
    df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """NULL for values outside their bounds. Rows stay; absent columns are skipped."""
    limits = DOMAIN_BOUNDS if bounds is None else bounds
    return df.select(
        *[
            within(F.col(c), *limits[c]).alias(c) if c in limits else F.col(c)
            for c in df.columns
        ]
    )


def bound_violations(
    df: DataFrame, bounds: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Rows below and above the bounds per column, in one pass."""
    limits = DOMAIN_BOUNDS if bounds is None else bounds
    present = [c for c in df.columns if c in limits]
    counts = df.agg(
        *[F.count_if(F.col(c) < limits[c][0]).alias(f"below_{c}") for c in present],
        *[F.count_if(F.col(c) > limits[c][1]).alias(f"above_{c}") for c in present],
    )
    return wide_to_rows(counts, present, ["below", "above"], "column_name")


def wide_to_rows(
    df: DataFrame,
    names: list[str],
    parts: list[str],
    label: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Turn aggregate columns `{part}_{name}` into one row per name."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias(label), *[F.col(f"{p}_{n}").alias(p) for p in parts])
            for n in names
        ]
    )
    return df.select(*(keep or []), F.inline(rows))


def holdout_split(df: DataFrame, cutoff: str, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and the rows after it."""
    return df.where(F.col(date) <= day(cutoff)), df.where(F.col(date) > day(cutoff))


def cutoff_guard(df: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    """Latest date and the number of rows past the cutoff."""
    return df.agg(
        F.max(date).alias("max_date"),
        F.count_if(F.col(date) > day(cutoff)).alias("rows_past_cutoff"),
    )


def assert_cutoff(df: DataFrame, cutoff: str, date: str = "date") -> None:
    found = cutoff_guard(df, cutoff, date).first()
    if found["rows_past_cutoff"]:
        raise ValueError(
            f"training rows reach {found['max_date']}, past the allowed {cutoff}"
        )


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def latest_complete_row(
    df: DataFrame, columns: list[str], series: str = "series_id", date: str = "date"
) -> DataFrame:
    """The latest row of every series with all columns known, plus the series' last date.

    `feature_date` is the date of the row used, `as_of_date` the last date present at all.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    used = F.when(complete, F.col(date))
    return (
        df.groupBy(series)
        .agg(
            F.max(date).alias("as_of_date"),
            F.max(used).alias("feature_date"),
            *[F.max_by(c, used).alias(c) for c in columns],
        )
        .where(F.col("feature_date").isNotNull())
    )


def deflate(
    df: DataFrame, prices: list[str], index: str = "price_index", keep_nominal: bool = True
) -> DataFrame:
    """Real prices: nominal / (index / 100). The nominal price stays as `{col}_nominal`."""
    if index not in df.columns:
        raise KeyError(f"column '{index}' is needed to deflate prices")
    present = [p for p in prices if p in df.columns]
    real = {p: safe_ratio(F.col(p), F.col(index) / 100) for p in present}
    nominal = [F.col(p).alias(f"{p}_nominal") for p in present] if keep_nominal else []
    return df.select(
        *[real[c].alias(c) if c in real else F.col(c) for c in df.columns], *nominal
    )


def price_index(
    df: DataFrame,
    base_month: str,
    pct: str = "pct",
    keys: list[str] | None = None,
    month: str = "month",
    index: str = "price_index",
    keep: list[str] | None = None,
) -> DataFrame:
    """Chained index of monthly percent changes, 100 in the base month.

    A month without a change has no index, the chain goes on after it. A series without the
    base month is an error when its rows are read. A series has one row per month.
    """
    by = keys or []
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    running = everything.orderBy(month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    growth = F.col(pct) / 100
    chained = F.when(F.col(pct).isNotNull(), F.exp(F.sum(F.log1p(growth)).over(running)))
    base = F.max(F.when(F.col(month) == day(base_month), F.col("_chain"))).over(everything)
    missing = F.raise_error(
        F.lit(f"base month {base_month} is not in the inflation series")
    ).cast("double")
    return df.withColumn("_chain", chained).select(
        *by,
        month,
        pct,
        *(keep or []),
        (F.col("_chain") / F.coalesce(base, missing) * 100).alias(index),
    )


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per column as count and percent of the rows, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in columns],
    )
    return wide_to_rows(counts, columns, ["n_missing"], "column_name", keep=["n_rows"]).select(
        "column_name",
        "n_missing",
        F.round(F.col("n_missing") / F.nullif(F.col("n_rows"), F.lit(0)) * 100, 2).alias(
            "pct_missing"
        ),
    )


def most_missing(df: DataFrame, columns: list[str], n: int = 15) -> DataFrame:
    """The `n` columns with the most missing values."""
    return (
        missing_report(df, columns)
        .orderBy(F.desc("n_missing"), "column_name")
        .limit(n)
        .select("column_name", "n_missing")
    )


def price_stats(
    df: DataFrame, columns: list[str], series: str = "series_id"
) -> DataFrame:
    """Minimum, maximum, mean and missing count of each price per series."""
    stats = df.groupBy(series).agg(
        *[F.min(c).alias(f"min_value_{c}") for c in columns],
        *[F.max(c).alias(f"max_value_{c}") for c in columns],
        *[F.avg(c).alias(f"mean_value_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in columns],
    )
    parts = ["min_value", "max_value", "mean_value", "n_missing"]
    return wide_to_rows(stats, columns, parts, "variable", keep=[series])


def describe_series(
    df: DataFrame, columns: list[str], series: str = "series_id", decimals: int = 2
) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per series and column.

    The exact percentile holds a group's distinct values in memory. The group is one daily
    series, bounded by the calendar; for panel-wide quantiles use `ordered.exact_quantiles`.
    """
    aggregates = []
    for c in columns:
        quarts = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggregates += [
            F.count(c).alias(f"n_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).alias(f"min_{c}"),
            quarts.alias(f"q_{c}"),
            F.max(c).alias(f"max_{c}"),
        ]
    flat = df.groupBy(series).agg(*aggregates).select(
        "*",
        *[
            F.element_at(f"q_{c}", k).alias(f"{name}_{c}")
            for c in columns
            for k, name in ((1, "q25"), (2, "q50"), (3, "q75"))
        ],
    )
    parts = ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]
    rows = wide_to_rows(flat, columns, parts, "variable", keep=[series])
    return rows.select(
        series, "variable", "n", *[F.round(p, decimals).alias(p) for p in parts[1:]]
    )


def dataset_extent(df: DataFrame, date: str = "date", series: str = "series_id") -> DataFrame:
    """First and last date, rows and series of a table."""
    per_series = df.groupBy(series).agg(
        F.min(date).alias("lo"), F.max(date).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return per_series.agg(
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
    ).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 10, keys: tuple[str, ...] = ("series_id", "date")) -> DataFrame:
    """First rows in key order; a bounded top-k, not a full sort."""
    return df.orderBy(*keys).limit(n)
