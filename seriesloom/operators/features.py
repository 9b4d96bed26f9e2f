"""Lag, rolling, change, calendar and ratio features, and the targets.

All window features share one specification (series, by date), so Spark plans them as one
window stage over one shuffle and one sort. The builders below return expressions; a table
is built with one `select`, never with a chain of `withColumn`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.dates import calendar_parts
from seriesloom.functions.numbers import zero_to_null
from seriesloom.operators.calendar import forward_fill
from seriesloom.settings import (
    BASELINE_DAYS,
    CHANGE_DAYS,
    FEATURE_COLUMNS,
    HORIZONS,
    LAG_DAYS,
    ROLLING_DAYS,
    TARGET_PRICE,
)

RATIOS = {"ratio_a_c": ("price_a", "price_c"), "ratio_a_b": ("price_a", "price_b")}
PADDED = "_padded_"


def _over(series: str, date: str, days: int | None = None) -> str:
    """Window clause of one series by date, over the trailing `days` rows when given.

    Window features are written as SQL expressions: a feature table has well over a hundred,
    and each is then one call to the driver's JVM instead of a dozen.
    """
    frame = f" ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW" if days else ""
    return f"OVER (PARTITION BY `{series}` ORDER BY `{date}`{frame})"


def lag_columns(
    columns: list[str], lags=LAG_DAYS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    over = _over(series, date)
    return {f"{c}_lag{k}d": F.expr(f"lag(`{c}`, {k}) {over}") for c in columns for k in lags}


def mean_columns(
    columns: list[str], days=ROLLING_DAYS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    return {
        f"{c}_ma{n}d": F.expr(f"avg(`{c}`) {_over(series, date, n)}") for c in columns for n in days
    }


def deviation_columns(
    columns: list[str], days=ROLLING_DAYS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    return {
        f"{c}_std{n}d": F.expr(f"stddev_samp(`{c}`) {_over(series, date, n)}")
        for c in columns
        for n in days
    }


def change_columns(
    columns: list[str], steps=CHANGE_DAYS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    """Relative change of gap-padded values; needs the columns of `padded`."""
    over = _over(series, date)
    return {
        f"{c}_pct{k}d": F.expr(f"try_divide(`{PADDED}{c}`, lag(`{PADDED}{c}`, {k}) {over}) - 1")
        for c in columns
        for k in steps
    }


def padded(
    df: DataFrame, columns: list[str], series: str = "series_id", date: str = "date"
) -> DataFrame:
    """Add forward-filled copies for `change_columns`."""
    return df.select("*", *[forward_fill(c, series, date).alias(PADDED + c) for c in columns])


def ratio_columns(available: list[str], ratios=None) -> dict[str, Column]:
    pairs = RATIOS if ratios is None else ratios
    return {
        name: F.col(top) / zero_to_null(F.col(bottom))
        for name, (top, bottom) in pairs.items()
        if top in available and bottom in available
    }


def target_columns(
    price: str = TARGET_PRICE, horizons=HORIZONS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    over = _over(series, date)
    return {f"target_h{h}d": F.expr(f"lead(`{price}`, {h}) {over}") for h in horizons}


def baseline_columns(
    price: str = TARGET_PRICE, days: int = BASELINE_DAYS, series: str = "series_id", date: str = "date"
) -> dict[str, Column]:
    return {
        "baseline_last": F.col(price),
        f"baseline_ma{days}": F.expr(f"avg(`{price}`) {_over(series, date, days)}"),
    }


def with_columns(df: DataFrame, *groups: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """One projection holding the kept columns and all groups of expressions."""
    kept = df.columns if keep is None else keep
    return df.select(*kept, *[e.alias(n) for group in groups for n, e in group.items()])


def feature_table(
    df: DataFrame,
    columns=FEATURE_COLUMNS,
    price: str = TARGET_PRICE,
    horizons=HORIZONS,
    lags=LAG_DAYS,
    days=ROLLING_DAYS,
    steps=CHANGE_DAYS,
    series: str = "series_id",
    date: str = "date",
) -> DataFrame:
    """All features and targets of a dense daily table; absent columns are skipped."""
    if price not in df.columns:
        raise KeyError(f"column '{price}' is needed for the targets")
    present = [c for c in columns if c in df.columns]
    return with_columns(
        padded(df, present, series, date),
        lag_columns(present, lags, series, date),
        mean_columns(present, days, series, date),
        deviation_columns(present, days, series, date),
        change_columns(present, steps, series, date),
        calendar_parts(F.col(date)),
        ratio_columns(df.columns),
        target_columns(price, horizons, series, date),
        keep=df.columns,
    )


def feature_names(
    columns: list[str],
    price: str = TARGET_PRICE,
    keys: tuple[str, ...] = ("series_id", "date"),
    excluded: tuple[str, ...] = ("target_h", "_nominal", "baseline_"),
) -> list[str]:
    """Model inputs: not the raw target price, targets, nominal prices or baselines."""
    return [
        c
        for c in columns
        if c != price and c not in keys and not any(part in c for part in excluded)
    ]
