"""Integration of sources into one daily panel, and its cleaning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.calendar import (
    CARRY,
    INTERPOLATE,
    day,
    fill_calendar,
    fill_both_ways,
    interpolate_columns,
    publication_lag,
)
from seriesloom.operators.combine import long_to_wide, share_by_date
from seriesloom.operators.tidy import dedupe_first, deflate, domain_bounds, holdout_split
from seriesloom.settings import (
    DOMAIN_BOUNDS,
    HOLDOUT_CUTOFF,
    INDEX_COLUMN,
    LAGGED_COLUMNS,
    MAX_GAP_DAYS,
    PRICE_COLUMNS,
    PUBLICATION_LAG_MONTHS,
)

CARRY_BOTH_WAYS = "carry_both_ways"


@dataclass(frozen=True)
class Source:
    """Sparse observations of some variables.

    `frame` is wide: `date`, one column per variable, and `series_id` unless the variables
    are shared by all series. `fill` says how days between observations are filled. With
    several rows of a series and day the first by the column `order` counts; without such a
    column they are an error.
    """

    frame: DataFrame
    variables: tuple[str, ...]
    fill: str = CARRY
    shared: bool = False
    order: str | None = None


def _observations(source: Source, start: str, end: str, series: str) -> DataFrame:
    """Long rows `(series, variable, date, value, fill)` inside the calendar."""
    keyed = source.frame.withColumn(series, F.lit("")) if source.shared else source.frame
    if source.order is not None:
        keyed = dedupe_first(keyed.select(series, "date", *source.variables, source.order), [series, "date"], source.order)
    rows = keyed.where(F.col("date").between(day(start), day(end))).unpivot(
        [series, "date"], list(source.variables), "variable", "value"
    )
    if source.fill != CARRY:
        rows = rows.where(F.col("value").isNotNull())
    mode = INTERPOLATE if source.fill == INTERPOLATE else CARRY
    return rows.withColumn("_fill", F.lit(mode))


def daily_panel(sources: list[Source], start: str, end: str, series: str = "series_id") -> DataFrame:
    """All variables of some sources on the daily calendar, one row per series and day.

    The sparse observations are stacked and partitioned by series once. Filling, pivoting
    and every later window over the series work inside that partitioning.
    """
    names = [v for s in sources for v in s.variables]
    stacked = reduce(
        DataFrame.unionByName, [_observations(s, start, end, series) for s in sources]
    ).repartition(series)
    dense = fill_calendar(
        stacked, [series, "variable"], start, end, "value", F.col("_fill")
    )
    wide = long_to_wide(dense, names, [series, "date"])
    both_ways = [v for s in sources if s.fill == CARRY_BOTH_WAYS for v in s.variables]
    if not both_ways:
        return wide
    return wide.select(
        *[fill_both_ways(c, series).alias(c) if c in both_ways else F.col(c) for c in wide.columns]
    )


def build_dataset(
    sources: dict[str, Source],
    start: str,
    end: str,
    include: list[str] | None = None,
    deflate_prices: bool = True,
    prices: tuple[str, ...] = PRICE_COLUMNS,
    index: str = INDEX_COLUMN,
    lagged: tuple[str, ...] = LAGGED_COLUMNS,
    lag_months: int = PUBLICATION_LAG_MONTHS,
    lag_deflator: bool = False,
) -> DataFrame:
    """One daily table of the selected sources.

    Prices are deflated by the index as it stands; the low-frequency columns, the index
    included, are then replaced by what was published by then. `lag_deflator` swaps the two
    steps. Variables shared by all series form a table of one row per day, which is added to
    the panel by date.
    """
    chosen = [sources[name] for name in (sources if include is None else include)]
    if not chosen:
        raise ValueError("no source was selected")
    own = [s for s in chosen if not s.shared]
    shared = [s for s in chosen if s.shared]

    def finish(df: DataFrame, steps_prices: bool) -> DataFrame:
        columns = [c for c in lagged if c in df.columns]
        if lag_deflator:
            df = publication_lag(df, columns, lag_months) if columns else df
            return deflate(df, list(prices), index) if steps_prices else df
        df = deflate(df, list(prices), index) if steps_prices else df
        return publication_lag(df, columns, lag_months) if columns else df

    if not own:
        return finish(daily_panel(shared, start, end), deflate_prices)
    panel = daily_panel(own, start, end)
    if not shared:
        return finish(panel, deflate_prices)
    # The shared columns are lagged on their own small table. The unlagged index travels
    # along under another name until the prices are deflated.
    common = daily_panel(shared, start, end).drop("series_id")
    columns = [c for c in lagged if c in common.columns]
    own_lagged = [c for c in lagged if c in panel.columns]
    own_index = index in panel.columns
    if deflate_prices and not own_index and index not in common.columns:
        raise KeyError(f"column '{index}' is needed to deflate prices")
    deflator = "_deflator"
    lagged_common = publication_lag(
        common.withColumn("_all", F.lit("")).withColumn(
            deflator, F.col(index) if index in common.columns else F.lit(None).cast("double")
        ),
        columns,
        lag_months,
        series="_all",
    ).drop("_all")
    merged = share_by_date(panel, lagged_common)
    # An index of each series goes before a shared one. Its own lag follows the deflation,
    # or precedes it when the deflator is to be lagged too.
    if own_lagged and lag_deflator:
        merged = publication_lag(merged, own_lagged, lag_months)
    if deflate_prices:
        merged = deflate(merged, list(prices), index if own_index or lag_deflator else deflator)
    if own_lagged and not lag_deflator:
        merged = publication_lag(merged, own_lagged, lag_months)
    return merged.drop(deflator)


def clean(
    df: DataFrame,
    columns: list[str],
    max_gap: int = MAX_GAP_DAYS,
    cutoff: str = HOLDOUT_CUTOFF,
    bounds: dict[str, tuple[float, float]] | None = None,
    exclude_holdout: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Bounds, gap filling and holdout split: `(training rows, holdout rows)`.

    The input has one row per (series, date), as `build_dataset` makes it. `clean_report`
    adds the reports of the step.
    """
    filled = interpolate_columns(domain_bounds(df, bounds), columns, max_gap)
    train, holdout = holdout_split(filled, cutoff)
    return (train if exclude_holdout else filled), holdout


@dataclass(frozen=True)
class CleanReport:
    """What a cleaning run saw: rows, values outside the bounds, missing values before and
    after, and the extremes and means of the prices, per column."""

    before: dict
    after: dict

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per column: n_below, n_above, n_missing_before, n_missing, pct_missing, and
        min_value, max_value, mean_value of prices."""
        names = [k.removeprefix("missing_") for k in self.before if k.startswith("missing_")]
        rows = []
        for c in names:
            n, gone = self.after["n_rows"], self.after[f"missing_{c}"]
            rows.append((
                c, self.before.get(f"below_{c}"), self.before.get(f"above_{c}"), self.before[f"missing_{c}"], gone,
                round(gone / n * 100, 2) if n else None,
                *(self.after.get(f"{part}_{c}") for part in ("min", "max", "mean")),
            ))
        return spark.createDataFrame(
            rows,
            "column_name string, n_below long, n_above long, n_missing_before long, n_missing long, pct_missing double, "
            "min_value double, max_value double, mean_value double",
        )


def clean_and_write(
    df: DataFrame,
    columns: list[str],
    write: Callable[[DataFrame], None],
    max_gap: int = MAX_GAP_DAYS,
    bounds: dict[str, tuple[float, float]] | None = None,
    prices: tuple[str, ...] = PRICE_COLUMNS,
) -> CleanReport:
    """Bounds and gap filling, written by `write`, with the reports of the step.

    The counts are observed metrics of the pass that writes the rows: there is no further
    scan, whatever the number of reports.
    """
    limits = DOMAIN_BOUNDS if bounds is None else bounds
    limited = [c for c in df.columns if c in limits]
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    priced = [c for c in prices if c in columns]
    before, after = Observation(), Observation()
    seen = df.observe(
        before, F.count(F.lit(1)).alias("n_rows"), *missing,
        *[F.count_if(F.col(c) < limits[c][0]).alias(f"below_{c}") for c in limited],
        *[F.count_if(F.col(c) > limits[c][1]).alias(f"above_{c}") for c in limited],
    )
    filled = interpolate_columns(domain_bounds(seen, bounds), columns, max_gap)
    write(
        filled.observe(
            after, F.count(F.lit(1)).alias("n_rows"), *missing,
            *[e(c).alias(f"{name}_{c}") for name, e in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in priced],
        )
    )
    return CleanReport(before.get, after.get)
